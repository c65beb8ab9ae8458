"""Near copies: texts whose word shingles have a Jaccard similarity of 0.8 or more.

Two indexes nominate, the exact shingle sets decide. The first is the fingerprints'
deletion-variant signatures (simhash). At 0.8 fingerprints of 64 bits differ in about
ten, beyond what such signatures can reach at a bearable number of them, so the
second is MinHash bands: a pair at 0.8 shares none of the 56 bands of seven hashes
with a probability of 2e-6, a pair at 0.2 shares one with 7e-4.

Texts of a band or fingerprint component are compared with the one of the smallest
id, the centre. Those found alike go, and the centre leaves the band. Of what is left,
small bands are finished by making every member a centre. A large one is a crowd of texts
that are similar but mostly not alike: its members are indexed anew by their prefixes, the
fifth of a text's shingles that fewest texts of the crowds have. Two texts at 0.8 share
at least one shingle of both prefixes, for certain, and texts that are not alike seldom do.
They are compared in the same way, so a text meets few others however large the crowd is,
and none is left out.

In the end the smallest id of each group stays, and each text that goes is alike to one
of a smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, cut, tidy, with_bloom
from .simhash import NEAR, near_duplicates

BANDS, EACH = 56, 7
LEAST = 0.8
SMALL = 16  # members of a band that are all compared


def shingles(text: bytes, words_each: int = 5) -> np.ndarray:
    """Distinct XXH64 hashes of the shingles of ASCII-lower-cased words; of a shorter text, the one of all its words."""
    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    last = max(len(words) - words_each, 0)
    return np.unique(np.array([digest(b" ".join(words[i : i + words_each])) for i in range(last + 1)], np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One number for each band of minima under random odd multipliers."""
    rng = np.random.default_rng(42)
    factor, plus = rng.integers(0, 1 << 64, (2, BANDS * EACH, 1), np.uint64)
    least = np.full(BANDS * EACH, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for a in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[a : a + 1024] * (factor | np.uint64(1)) + plus).min(axis=1))
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, EACH).T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def alike(one: np.ndarray, other: np.ndarray, least: float = LEAST) -> bool:
    """Is the Jaccard similarity of two shingle sets, sorted, at least least?"""
    if min(len(one), len(other)) < least * max(len(one), len(other)):
        return False
    at = np.searchsorted(one, other)
    common = int((one[np.minimum(at, len(one) - 1)] == other).sum())
    return common >= least * (len(one) + len(other) - common)


def _sketch(words_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, 1000) for whole in batches for a in range(0, whole.num_rows, 1000)):
            key = batch.column(0).to_numpy()
            key, first = np.unique(key, return_index=True)  # copies side by side need one sketch
            found = np.concatenate([bands(shingles(batch.column(1)[k].as_buffer().to_pybytes(), words_each)) for k in first.tolist()])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1, dtype=np.int32) * BANDS), pa.array(found.view(np.int64)))
            yield pa.record_batch([pa.array(key), lists], names=["key", "bands"])
        tidy()

    return run


def _sets(words_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, 500) for whole in batches for a in range(0, whole.num_rows, 500)):
            sets = [shingles(t.as_buffer().to_pybytes(), words_each).tobytes() for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], names=["key", "set"])
        tidy()

    return run


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n, shingle) of sets (key, set) with n shingles."""
    for batch in (whole.slice(a, 100) for whole in batches for a in range(0, whole.num_rows, 100)):
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
        n = np.array([len(x) for x in sets], np.int64)
        yield pa.record_batch([pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(np.repeat(n, n)), pa.array(np.concatenate([np.empty(0, np.int64), *sets]))], names=["key", "n", "shingle"])
    tidy()


def prefixes(sets: DataFrame, least: float, files: int | None = None) -> DataFrame:
    """(key, band, size, at): of each set the shingles, as bands, that any set at a similarity of least or more has one of among its own.

    Such two have least of either's shingles in common. In one order for all sets, rarest
    first, the common ones can't all lie behind the first n - least n + 1 of a set's n.
    What no other set has comes first and is left out. A set has size shingles, and the band
    is the at-th of them.
    """
    each = cut(sets.mapInArrow(_each, "key long, n long, shingle long"), "shingles", files)
    often = cut(each.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1"), "often", files)
    own = Window.partitionBy("key")
    found = each.join(often, "shingle").withColumn("m", F.count("*").over(own)).withColumn("r", F.row_number().over(own.orderBy("times", "shingle")))
    first = F.col("n") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-6)) + 1
    place = F.col("n") - F.col("m") + F.col("r")
    return found.where(place <= first).select("key", F.col("shingle").alias("band"), F.col("n").alias("size"), place.alias("at"))


def _check(least: float):
    """The pairs whose sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.zeros(batch.num_rows, bool)
            for k, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                hit[k] = alike(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), least)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(hit)], names=["a", "b", "alike"])
        tidy()

    return run


def _linked(sets: DataFrame, links: DataFrame, end: str) -> DataFrame:
    """(key, set_<end>) of the sets that may be that end of a link: the others, most of them in all rounds but the first, are not shuffled."""
    marked, maybe = with_bloom(sets.withColumn("k1", F.col("key")), links.select(F.col(f"{end}.key").alias("k1")))
    return marked.where(maybe).select("key", F.col("set").alias(f"set_{end}"))


def _kept(rows: DataFrame, keepers: DataFrame, unsure: DataFrame) -> DataFrame:
    """_row of the rows (_row, key, label) that are keepers, one of each; only rows of a key that is unsure are shuffled."""
    marked, maybe = with_bloom(rows.withColumn("k1", F.col("key")), unsure.select(F.col("key").alias("k1")))
    rest = marked.where(maybe).select("_row", "key", "label").join(keepers, ["key", "label"], "left_semi").dropDuplicates(["key", "label"])
    return marked.where(~maybe).select("_row").unionByName(rest.select("_row"))


def _compared(links: DataFrame, sets: DataFrame, least: float, files: int) -> DataFrame:
    """links (a, b), each once, with whether their texts are alike."""
    with_b = links.withColumn("key", F.col("b.key")).join(_linked(sets, links, "b"), "key").drop("key")
    both = with_b.withColumn("key", F.col("a.key")).join(_linked(sets, links, "a"), "key").drop("key")
    place = "struct<null: boolean, id: long, key: long>"
    return cut(both.select("a", "b", "set_a", "set_b").coalesce(files).mapInArrow(_check(least), f"a {place}, b {place}, alike boolean"), "compared")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words_each: int = 5, near: int = NEAR, least: float = LEAST) -> DataFrame:
    """docs without near copies: no two texts stay at a similarity of least or more; of such two the smaller id does.

    Of texts that are equal, whatever their rows' ids, one row stays, so of repeated
    rows too; a null id counts as larger than all. Null and empty texts are alike.
    Columns stay as they are; an empty table gives an empty one. Texts go by a
    64-bit hash of theirs.
    """
    files = buckets_for(docs, 8 << 20, 2 * docs.sparkSession.sparkContext.defaultParallelism)  # of a table that a shuffle makes, at most
    text, name = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    label = F.coalesce(F.col("place.id").cast("string"), F.lit("")).alias("label")
    key = F.xxhash64(text)
    named = docs.select(key.alias("key"), F.struct(name.isNull().alias("null"), name.alias("id"), key.alias("key")).alias("place"), text.alias("text"))
    firsts = cut(named.groupBy("key").agg(F.min("place").alias("place")), "firsts", files)  # of each text; copies have ids of their own, so key and id together are no hot key
    sketches = cut(named.select("key", "text").mapInArrow(_sketch(words_each), "key long, bands array<long>"), "bands")
    flat = sketches.select("key", F.explode("bands").alias("band"))
    shared = cut(flat.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("band"), "shared", files)
    live = cut(flat.join(shared, "band", "left_semi").join(firsts, "key").select("band", "place"), "members", files)
    prints = near_duplicates(named.select("key", "text"), "key", "text", words_each=words_each, near=near, files=files)
    member = cut(prints.select("component_id", F.col("doc_id").alias("key")).distinct().join(firsts, "key").select("component_id", "place"), "components", files)
    first = cut(member.groupBy("component_id").agg(F.min("place").alias("a")), "centres", files)
    by_print = cut(member.join(first, "component_id").where("a < place").select("a", F.col("place").alias("b")), "by_print", files)
    ends = live.select("place").unionByName(by_print.select(F.col("a").alias("place"))).unionByName(by_print.select(F.col("b").alias("place")))
    wanted = cut(ends.distinct().select(F.col("place.key").alias("key"), label), "wanted", files)
    marked, maybe = with_bloom(named.select("key", label, "text", F.col("key").alias("k1")), wanted.select(F.col("key").alias("k1")))  # most texts have no candidate and stay where they are
    texts = marked.where(maybe).select("key", "label", "text").join(wanted, ["key", "label"], "left_semi").dropDuplicates(["key", "label"])
    sets = cut(texts.select("key", "text").coalesce(files).mapInArrow(_sets(words_each), "key long, set binary"), "sets")
    tested = gone = None
    links = cut(_centred(live, 1, files, least).unionByName(by_print).distinct(), "links", files)
    for refined in (False, True):
        if refined:
            crowd = cut(large.select("place").distinct().join(gone, "place", "left_anti"), "crowd", files)
            if crowd.isEmpty():
                large = crowd
                break
            own = cut(crowd.select(F.col("place.key").alias("key")).distinct(), "keys", files)
            rare = prefixes(sets.join(own, "key", "left_semi"), least, files)
            keyed = cut(rare.join(crowd.withColumn("key", F.col("place.key")), "key").select("band", "place", "size", "at"), "prefixes", files)
            several = cut(keyed.groupBy("band").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a < b").select("band"), "several", files)
            live = cut(keyed.join(several, "band", "left_semi"), "members", files)
            links = cut(_centred(live, 1, files, least).join(tested, ["a", "b"], "left_anti"), "links", files)
        for centres in (1, SMALL):
            fresh = _compared(links, sets, least, files)
            tested = fresh if tested is None else tested.unionByName(fresh)
            gone = cut(tested.where("alike").select(F.col("b").alias("place")).distinct(), "gone", files)
            if centres < SMALL:
                left = live.join(cut(_first(live), "centres", files).select("band", F.col("a").alias("place")), ["band", "place"], "left_anti").distinct()
                live = cut(left.join(gone, "place", "left_anti"), "members", files)
                sizes = cut(live.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "sizes", files)
                large = live.join(sizes.where(F.col("n") > SMALL).select("band"), "band", "left_semi")
                small = live.join(sizes.where(F.col("n") <= SMALL).select("band"), "band", "left_semi")
                links = cut(_centred(cut(small, "small", files), SMALL, files, least).join(tested, ["a", "b"], "left_anti"), "links", files)
    centres = 2
    while not large.isEmpty():  # crowds that share a shingle of their prefixes: more centres each time
        large = cut(large.join(gone, "place", "left_anti"), "large", files)
        links = cut(_centred(large, centres, files, least).join(tested, ["a", "b"], "left_anti"), "links", files)
        fresh = _compared(links, sets, least, files)
        tested = tested.unionByName(fresh)
        gone = cut(tested.where("alike").select(F.col("b").alias("place")).distinct(), "gone", files)
        ranked = cut(_ranked(large), "ranked", files)
        over = ranked.where(F.col("n") > centres).drop("n")
        more = cut(over.groupBy("band").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a < b").select("band"), "several", files)
        large, centres = cut(over.join(more, "band", "left_semi"), "large", files), 2 * centres
    losers = cut(tested.where("alike").select(F.col("b.key").alias("key")).distinct(), "losers", files)
    keepers = cut(firsts.join(losers, "key", "left_anti").select("key", label), "keepers", files)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, key.alias("key"), F.coalesce(name.cast("string"), F.lit("")).alias("label"))
    times = rows.groupBy("key", "label").agg(F.count("*").alias("n")).join(keepers.withColumn("stays", F.lit(True)), ["key", "label"], "left")
    unsure = cut(times.where("stays is null or n > 1").select("key"), "unsure", files)  # texts of which a row goes
    return _kept(rows, keepers, unsure).select("_row.*").coalesce(files)


def _first(members: DataFrame) -> DataFrame:
    """(band, a, a_size, a_at): the first member of each band that has more than one; sizes and places where members have them."""
    own = [c for c in ("size", "at") if c in members.columns]
    found = members.groupBy("band").agg(F.min(F.struct("place", *own)).alias("low"), F.max("place").alias("high")).where("low.place < high")
    return found.select("band", F.col("low.place").alias("a"), *[F.col(f"low.{c}").alias(f"a_{c}") for c in own])


def _ranked(members: DataFrame) -> DataFrame:
    return members.distinct().withColumn("n", F.row_number().over(Window.partitionBy("band").orderBy("place")))


def _centred(members: DataFrame, centres: int, files: int, least: float) -> DataFrame:
    """Links (a, b) from the first members of each band to those after them, each once.

    Bands of prefixes have a place in each set's order. At the first band that two sets
    share, what they have in common is it and what follows in both; where that is too
    little for least, the two are not alike, or they meet in an earlier band.
    """
    own = [c for c in ("size", "at") if c in members.columns]
    first = _first(members) if centres == 1 else _ranked(members).where(F.col("n") <= centres).select("band", F.col("place").alias("a"), *[F.col(c).alias(f"a_{c}") for c in own])
    both = members.join(cut(first, "centres", files), "band").where("a < place")
    if own:
        both = both.where(1 + F.least(F.expr("size - at"), F.expr("a_size - a_at")) >= F.expr("size + a_size") * F.lit(least / (1 + least)) - F.lit(1e-6))
    return both.select("a", F.col("place").alias("b")).distinct()
