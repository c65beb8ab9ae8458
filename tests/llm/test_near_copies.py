"""Near copies against brute force by Jaccard similarity."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from odflow.llm.near_copies import alike, bands, keep_one, shingles
from odflow.llm.near_copies import prefixes as near_copies_prefixes

SF = "/root/testdata/sf0.001"


def slow_sets(texts):
    out = []
    for t in texts:
        words = (t or "").encode().lower().split()
        out.append({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))})
    return out


def slow_groups(rows, least=0.8):
    """Id -> the smallest id of its component, of rows (id, text); and the pairs of ids that are alike."""
    rows = sorted(rows)
    sets, left, group, pairs = slow_sets(t for _, t in rows), list(range(len(rows))), {}, set()
    near = lambda a, b: len(a & b) >= least * len(a | b)
    while left:
        edge, left, first = [left[0]], left[1:], rows[left[0]][0]
        group[first] = first
        while edge:
            x = edge.pop()
            hits = [k for k in left if near(sets[x], sets[k])]
            group |= {rows[k][0]: first for k in hits}
            edge, left = edge + hits, [k for k in left if k not in set(hits)]
    pairs = {(rows[i][0], rows[k][0]) for i in range(len(rows)) for k in range(i) if near(sets[i], sets[k])}
    return group, pairs


def check_kept(rows, kept):
    """Each group keeps its smallest id; no two that are alike are kept."""
    group, pairs = slow_groups(rows)
    kept = set(kept)
    assert set(group.values()) <= kept
    assert not [p for p in pairs if set(p) <= kept]


def varied(rng):
    """Near copies of few texts with up to a third of their words changed, in runs and alone."""
    words = [f"w{k}" for k in range(500)]
    out = [None, "", "One two", "one TWO", "x " * 50]
    for _ in range(4):
        base = rng.choice(words, 120)
        for _ in range(40):
            t = base.copy()
            for _ in range(rng.integers(0, 7)):
                at = rng.integers(0, 118)
                t[at : at + rng.integers(1, 3)] = "changed%d" % rng.integers(99)
            out.append(" ".join(t))
    return out


def test_alike():
    texts = varied(np.random.default_rng(5))
    sets = slow_sets(texts)
    hashes = [shingles((t or "").encode()) for t in texts]
    assert all(alike(hashes[i], hashes[k]) == (len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k])) for i in range(0, len(sets), 5) for k in range(len(sets)))


def test_keep_one(spark):
    texts = varied(np.random.default_rng(6))
    rows = [(i * 7 % 1009, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[9], (None, texts[9], "null")], "doc_id long, text string, key string").repartition(3)
    got = keep_one(df)
    ids = [r.doc_id for r in got.collect()]
    assert got.columns == df.columns and len(set(ids)) == len(ids) and None not in ids
    check_kept([(i, t) for i, t, _ in rows], ids)
    assert keep_one(df.limit(0)).count() == 0


def test_crowds(spark, monkeypatch):
    """Many texts that are similar to each other, few of which are alike; and as many that are alike."""
    from odflow.llm import near_copies

    monkeypatch.setattr(near_copies, "SMALL", 4)
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(3000)]
    base, rows = rng.choice(words, 150), []
    for i in range(150):  # about three changed words each: pairs near 0.67
        t = base.copy()
        t[rng.choice(150, 3, replace=False)] = rng.choice(words, 3)
        rows.append((i, " ".join(t)))
        if i % 10 == 0:  # and a copy that is alike
            t[5] = "other"
            rows.append((1000 + i, " ".join(t)))
    other = " ".join(rng.choice(words, 150))
    rows += [(2000 + i, f"{other} tail{i}") for i in range(200)]
    got = [r.doc_id for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    group, pairs = slow_groups(rows)
    assert set(group.values()) <= set(got) and [i for i in got if i >= 2000] == [2000]
    both = [p for p in pairs if set(p) <= set(got)]
    assert len(both) <= 0.1 * len({i for p in pairs for i in p if i < 2000}), both


def test_crowds_are_whole(spark, monkeypatch):
    """In a crowd whose texts share a single band, no pair just above the threshold is missed."""
    from odflow.llm import near_copies

    def one_shared(hashes):
        own = bands(hashes)
        return np.r_[np.uint64(1), own[1:] + hashes.sum()]

    monkeypatch.setattr(near_copies, "SMALL", 4)
    monkeypatch.setattr(near_copies, "bands", one_shared)
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(3000)]
    base, rows = rng.choice(words, 150), []
    for i in range(100):
        t = base.copy()
        t[rng.choice(150, 6, replace=False)] = rng.choice(words, 6)
        rows.append((i, " ".join(t)))
        t[np.array([10, 60, 110]) + rng.integers(0, 30)] = rng.choice(words, 3)  # some 15 of 146 shingles: about 0.81
        rows.append((1000 + i, " ".join(t)))
    got = {r.doc_id for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    check_kept(rows, got)
    assert len(slow_groups(rows)[1]) > 50 and len(got) > 50


def test_prefixes(spark):
    """Every two sets that are alike share a band; a set has at most a fifth of its shingles and one as bands."""
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.choice(60, rng.integers(1, 50))) for _ in range(120)]
    sets += [np.unique(np.r_[s[: len(s) * 9 // 10], rng.integers(0, 60)]) for s in sets]
    df = spark.createDataFrame([(k, s.astype(np.int64).tobytes()) for k, s in enumerate(sets)], "key long, set binary").repartition(3)
    bands_of = {}
    for r in near_copies_prefixes(df, 0.8).collect():
        bands_of.setdefault(r.key, set()).add(r.band)
    pairs = [(i, k) for i in range(len(sets)) for k in range(i) if alike(sets[k].astype(np.uint64), sets[i].astype(np.uint64))]
    assert len(pairs) > 50 and all(bands_of[i] & bands_of[k] for i, k in pairs)
    assert all(len(b) <= len(sets[k]) // 5 + 1 for k, b in bands_of.items())


def test_only_null_ids(spark):
    rows = [(None, "some words that are the same"), (None, "some words that are the same"), (None, "quite another text"), (None, None)]
    assert sorted(r.text or "" for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == ["", "quite another text", "some words that are the same"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_the_pipelines_stage(spark):
    import corpus_pipeline
    from odflow.llm.common import table

    docs = table(spark, SF, "documents")
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, SF)
    assert kept.columns == docs.columns
    check_kept([(r.doc_id, r.text) for r in docs.collect()], [r.doc_id for r in kept.collect()])


def test_only_texts_that_are_linked_or_go_are_shuffled(spark):
    from odflow.llm import near_copies

    sets = spark.range(2000).select((F.col("id") * 7919).alias("key"), F.lit(b"x").alias("set"))
    place = lambda k: F.struct(F.lit(False).alias("null"), F.lit(1).cast("long").alias("id"), F.lit(k).cast("long").alias("key"))
    links = spark.range(1).select(place(7919).alias("a"), place(15838).alias("b"))
    for end, key in (("a", 7919), ("b", 15838)):
        found = [r.key for r in near_copies._linked(sets, links, end).collect()]
        assert key in found and len(found) < 20
    rows = spark.createDataFrame([(k % 5, str(k % 5)) for k in range(8)], "key long, label string").withColumn("_row", F.struct("key"))
    keepers = spark.createDataFrame([(0, "0"), (1, "1"), (2, "2"), (4, "4")], "key long, label string")
    unsure = spark.createDataFrame([(0,), (1,), (2,), (3,)], "key long")  # 0, 1 and 2 twice, 3 goes
    assert sorted(r._row.key for r in near_copies._kept(rows, keepers, unsure).collect()) == [0, 1, 2, 4]


def test_small_tables_are_few_files(spark):
    """However many partitions shuffles have, a table is written by two tasks a core at most, if its input is small."""
    from odflow.llm.common import shared_dir

    rows = [(i, f"{t} {i}" if i % 3 else t) for i, t in enumerate(varied(np.random.default_rng(11))[:40])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    shared = shared_dir(spark).removeprefix("file:")
    few = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, was = set(os.listdir(shared)), {k: spark.conf.get(k) for k in few}
    try:
        for k, v in few.items():
            spark.conf.set(k, v)
        got = keep_one(df)
        assert got.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
        ids = [r.doc_id for r in got.collect()]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    check_kept(rows, ids)
    made = {d: sum(f.endswith(".parquet") for f in os.listdir(f"{shared}/{d}")) for d in set(os.listdir(shared)) - before}
    assert len(made) > 20 and max(made.values()) <= 2 * spark.sparkContext.defaultParallelism, made


def test_members_of_a_prefix_meet_only_where_enough_follows(spark):
    """Of sets that share one band late in their order no link is made; where enough follows, it is."""
    from odflow.llm import near_copies

    place = "named_struct('null', false, 'id', id, 'key', id) place"
    members = spark.range(6).selectExpr("id % 2 band", place, "100L size", "if(id % 2 = 0, 5L, 18L) at")  # 96 and 83 of at least 88.9 follow
    for centres, want in ((1, {(0, 2), (0, 4)}), (4, {(0, 2), (0, 4), (2, 4)})):
        assert {(r.a.id, r.b.id) for r in near_copies._centred(members, centres, 2, 0.8).collect()} == want
