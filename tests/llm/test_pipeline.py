"""The corpus pipeline, stage by stage and as a whole, and its absence."""

import os
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
REPO = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages(spark):
    from odflow.llm.common import cut, table

    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF), name)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    assert docs.selectExpr("bool_and(n_chars = length(text))").first()[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    ran = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == before
    assert sorted(map(tuple, packed.select("doc_id", "start", "ids_crc32").collect())) == sorted(map(tuple, ran.select("doc_id", "start", "ids_crc32").collect()))


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_rules(rows):
    """Rows that the rules keep, their texts without frequent lines."""
    norm = lambda x: " ".join(WORD.findall(x.lower()))
    texts = {}
    for r in rows:
        texts.setdefault(r["source"], set()).add(r["text"] or "")
    seen = {s: Counter(h for t in ts for h in {norm(x) for x in t.split("\n")} if h) for s, ts in texts.items()}
    out = []
    for r in rows:
        text, n = r["text"] or "", len(WORD.findall(r["text"] or ""))
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 8]) for i in range(n - 7)]
        count = Counter(windows)
        repeated = len({i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)})
        often = lambda x: norm(x) and seen[r["source"]][norm(x)] > 10  # noqa: E731, B023
        left = [x for x in text.split("\n") if not often(x)]
        kept_words = sum(len(WORD.findall(x)) for x in left)
        if n >= 20 and 100 * repeated <= 30 * n and (len(left) == len(text.split("\n")) or kept_words >= 0.3 * n):
            out.append((r["doc_id"], "\n".join(left)))
    return sorted(out)


def slow_mixture(spark, rows):
    """Ids of the rows that are drawn, by topics, cells and probabilities of loops."""
    from test_operators import slow_topics

    from odflow.llm.mixing import probabilities
    from odflow.llm.queries import TARGETS

    languages = [*TARGETS["lang"], None]
    number = [languages.index(r["lang"]) if r["lang"] in TARGETS["lang"] else 4 for r in rows]
    topics = slow_topics([(r["text"], n) for r, n in zip(rows, number)], 5)
    cell = [(0 if r["source"] == "src0" else 1, n, int(t[1:])) for r, n, t in zip(rows, number, topics)]
    seen = np.zeros((2, 5, 9))
    for r, c in zip(rows, cell):
        seen[c] += len((r["text"] or "").split())
    wanted = [np.array([0.3, 0.7]), np.array([0.6, 0.15, 0.15, 0.1, 0.0]), np.array([0.125] * 8 + [0.0])]
    chance = probabilities(seen, wanted)
    drawn = spark.createDataFrame([(i, r["doc_id"], r["text"]) for i, r in enumerate(rows)], "i long, id long, text string").selectExpr("i", "shiftrightunsigned(xxhash64(cast(id as string), text, 17), 11) / double(9007199254740992) as u").collect()
    return sorted(rows[r.i]["doc_id"] for r in drawn if r.u < chance[cell[r.i]])


def slow_ids(rows):
    """Token ids by document, from the tokenizer itself."""
    from tokenizers import Tokenizer

    from odflow.llm.packing import default_tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    return {r["doc_id"]: tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in rows}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages_against_brute_force(spark):
    """Every stage on its own input, by loops over its rows."""
    from test_near_copies import check_kept
    from test_privacy_formats import KEY, new_texts, slow_text, sure_kind

    import regex  # noqa: F811
    from odflow.llm import privacy
    from odflow.llm.common import cut, table

    spark.conf.set("spark.odflow.private.key", KEY)
    stages, docs = dict(corpus_pipeline.STAGES), table(spark, SF, "documents")
    rows = lambda d: [r.asDict() for r in d.collect()]
    ruled = cut(stages["quality_rules"](spark, docs, SF), "t")
    assert sorted((r["doc_id"], r["text"]) for r in rows(ruled)) == slow_rules(rows(docs))
    alone = cut(stages["simhash_near_dedup"](spark, ruled, SF), "t")
    check_kept([(r["doc_id"], r["text"]) for r in rows(ruled)], [r["doc_id"] for r in rows(alone)])
    private = cut(stages["private_pseudonyms"](spark, alone, SF), "t")
    before, after = ({r["doc_id"]: r["text"] for r in rows(d)} for d in (alone, private))
    others = sorted({m[0] for t in before.values() for m in regex.finditer(privacy._CANDIDATE, t, flags=regex.ASCII) if not sure_kind(m[0])})
    new_of = dict(zip(others, (t for t, _ in new_texts(spark, others)), strict=True)) if others else {}
    assert after == {i: slow_text(t, new_of.__getitem__) for i, t in before.items()} and after != before
    mixed = cut(stages["source_mixing"](spark, private, SF), "t")
    assert sorted(r["doc_id"] for r in rows(mixed)) == slow_mixture(spark, rows(private))
    assert all(after[r["doc_id"]] == r["text"] for r in rows(mixed))
    ids, taken = slow_ids(rows(mixed)), []
    for r in rows(stages["packing"](spark, mixed, SF)):
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
        taken += range(r["sequence_id"] * 4096 + r["offset"], r["sequence_id"] * 4096 + r["offset"] + r["length"])
    assert sorted(taken) == list(range(sum(map(len, ids.values()))))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, `band` string, place string, label string, host string, h string, page string, tokens string, topic string, language string, part string, _row string"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, name):
    """Nulls in all columns, empty and very long texts, repeated rows and ids, columns named like those within, and no rows at all."""
    prose = " ".join(f"word{k % 83}x{k % 7}" for k in range(200))
    rows = [(1, prose, "en", "src0"), (1, prose, "en", "src0"), (1, prose[300:] + " the end", "de", None), (None, prose + " more", None, "src1"), (None, None, None, None), (2, None, "xx", "src2"), (3, "", "en", "src0"), (4, " \n\t", "en", "src0"), (5, "long " + prose * 60, "fr", "src0"), (6, "x" * 300_000, "es", "src0")]
    rows = [(*r, None if r[1] is None else len(r[1]), *["clash"] * 12) for r in rows]
    rows.append((None,) * 17)
    stage = dict(corpus_pipeline.STAGES)[name]
    df = spark.createDataFrame(rows, SCHEMA)
    got = stage(spark, df.repartition(2), SF)
    found = got.collect()
    if name == "packing":
        assert sum(r.length for r in found) == sum(r.doc_tokens for r in found if r.start == 0)
        assert sum(r.start == 0 for r in found) == len(rows)
    else:
        assert got.columns == df.columns and {r._row for r in found} <= {"clash", None}
        count = {"quality_rules": 4, "simhash_near_dedup": 3, "private_pseudonyms": len(rows)}.get(name)
        assert count is None and len(found) <= len(rows) or len(found) == count
    assert stage(spark, df.limit(0), SF).count() == 0


def test_nothing_else_imports_it():
    code = "import sys; sys.modules['odflow.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'tile_cpc' in q and not any(k.startswith('op') and k[2].isdigit() for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, env=os.environ | {"PYTHONPATH": REPO})
