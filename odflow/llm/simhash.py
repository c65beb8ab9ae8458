"""SimHash near-duplicates through signatures with one deleted bit.

Fingerprints within 4 bits differ in at most one bit in at least one of three
segments. So each fingerprint is indexed under its three segments and under each
segment with one bit deleted, 67 signatures; equal signatures meet and the pair is
verified. Two fingerprints under a deleted bit are compared only if they differ
there, for equal segments meet under the whole segment already.

A signature with very many fingerprints is cut again: its members' other bits make
three new segments, by the same rule, until the buckets are small or no bits are
left, when fingerprints differ in deleted bits only and are few. Within a bucket only
a spanning forest of the links is kept, so output grows with documents, not with
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, cut, runs, tidy
from .components import components

BITS, NEAR, SEGMENTS = 64, 4, 3
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, words_each: int = 4, seed: int = 42) -> int:
    """Majority bits of XXH64 over shingles of ASCII-lower-cased words; zero without words."""
    words = text.lower().split()  # splits bytes at exactly space, tab, LF, VT, FF, CR
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= words_each:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.r_[0, ends[:-words_each] + 1].tolist()
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(begins, ends[words_each - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[a : a + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(words_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows, np.uint64)
            for k, text in enumerate(batch.column(1)):
                raw = text.as_buffer()
                out[k] = fingerprint(raw.to_pybytes(), words_each) if raw is not None else 0
            yield pa.record_batch([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])
        tidy()

    return run


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(key: np.ndarray, used: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """(key, bits used so far, deleted bit or -1, fingerprints) for all rows of one `used` mask at a time."""
    for mask in np.unique(used):
        rows = used == mask
        k, f = key[rows], fp[rows]
        free = [b for b in range(BITS) if not int(mask) >> b & 1]
        for s, segment in enumerate(np.array_split(np.array(free, np.uint64), min(SEGMENTS, len(free)) or 1)):
            part = np.bitwise_or.reduce(np.uint64(1) << segment) if len(segment) else np.uint64(0)
            now = np.full(len(f), mask | part)
            yield _mix(_mix(k + np.uint64(s + 1)) ^ (f & part)), now, -1, f
            for b in segment.tolist():
                yield _mix(_mix(k + np.uint64(8 + b)) ^ (f & part & ~(np.uint64(1) << np.uint64(b)))), now, b, f


def _expand(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, 2500) for whole in batches for a in range(0, whole.num_rows, 2500)):  # 67 signatures a row
            x = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("key", "used", "fp")]
            parts = [(k, u, np.full(len(k), bit, np.int8), f) for k, u, bit, f in signatures(*x)]
            if not parts:
                continue
            key, used, bit, fp = (np.concatenate(c) for c in zip(*parts, strict=True))
            bucket = (key >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            key, used, bit, fp = key[order], used[order], bit[order], fp[order]
            full, cuts = runs(bucket[order])
            cols = [pa.array([c[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()) for c in (key, used, bit, fp)]
            yield pa.record_batch([pa.array(full.astype(np.int64)), *cols], names=["bucket", "keys", "masks", "bits", "fps"])
        tidy()

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """The pairs that join two trees, in order."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    one, two = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            one.append(x)
            two.append(y)
    return one, two


def _links(fp: np.ndarray, bit: int, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one large bucket, as a forest: each fingerprint found is compared with those not yet found."""
    left, one, two = fp.copy(), [], []
    while len(left) > 1:
        edge, left = left[:1], left[1:]
        while len(edge) and len(left):
            x, edge = edge[0], edge[1:]
            differ = left ^ x
            hit = np.bitwise_count(differ) <= near
            if bit >= 0:
                hit &= (differ >> np.uint64(bit) & np.uint64(1)).astype(bool)
            found = left[hit]
            one.append(np.full(len(found), x))
            two.append(found)
            edge, left = np.concatenate([edge, found]), left[~hit]
    return (np.concatenate(one), np.concatenate(two)) if one else (fp[:0], fp[:0])


def _match(near: int, large: int):
    """Of a bucket of signatures: verified links, or the members of signatures to be cut again."""

    def run(rows: pa.Table) -> pa.Table:
        key, used, bit, fp = (np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in (("keys", "<u8"), ("masks", "<u8"), ("bits", "i1"), ("fps", "<u8")))
        order = np.lexsort((fp, key))
        key, used, bit, fp = key[order], used[order], bit[order], fp[order]
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[edges, len(key)])
        out_a, out_b = [], []
        size_of = np.repeat(sizes, sizes)
        at, d = np.flatnonzero((size_of > 1) & (size_of <= 64)), 1
        while True:  # small signatures: all at once, each row with the d-th after it
            at = at[at + d < len(key)]
            at = at[key[at] == key[at + d]]
            if not len(at):
                break
            differ = fp[at] ^ fp[at + d]
            own = np.maximum(bit[at], 0).astype(np.uint64)
            hit = (np.bitwise_count(differ) <= near) & ((bit[at] < 0) | (differ >> own & np.uint64(1)).astype(bool)) & (differ != 0)
            out_a.append(fp[at[hit]])
            out_b.append(fp[at[hit] + d])
            d += 1
        again = []
        for e, n in zip(edges[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
            if n > large and int(used[e]) != int(ALL):
                again.append(np.arange(e, e + n))
            else:
                a, b = _links(np.unique(fp[e : e + n]), int(bit[e]), near)
                out_a.append(a)
                out_b.append(b)
        a, b = _forest(np.concatenate(out_a), np.concatenate(out_b)) if out_a else ([], [])
        more = np.concatenate(again) if again else np.empty(0, np.int64)
        signed = lambda x: np.asarray(x, np.uint64).view(np.int64)
        n, m = len(a), len(more)
        return pa.table({
            "a": pa.array(np.r_[signed(a), signed(key[more])]),
            "b": pa.array(np.r_[signed(b), signed(used[more])]),
            "fp": pa.array(np.r_[np.zeros(n, np.int64), signed(fp[more])]),
            "again": pa.array(np.r_[np.zeros(n, bool), np.ones(m, bool)]),
        })

    return run


def near_links(prints: DataFrame, buckets: int, near: int = NEAR, large: int = 4096, files: int | None = None) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of the distinct fingerprints fp within near bits."""
    if near // SEGMENTS > 1:
        raise ValueError("three segments leave at most one bit in one of them only up to 5 differing bits")
    todo, found = prints.select(F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("used"), "fp"), None
    while found is None or not todo.isEmpty():  # each time at least a third of the bits left are used up
        blobs = todo.mapInArrow(_expand(buckets), "bucket long, keys binary, masks binary, bits binary, fps binary")
        out = cut(blobs.groupBy("bucket").applyInArrow(_match(near, large), "a long, b long, fp long, again boolean"), "links", files)
        links = out.where("not again").select("a", "b")
        found = links if found is None else found.unionByName(links)
        todo = out.where("again").select(F.col("a").alias("key"), F.col("b").alias("used"), "fp")
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words_each: int = 4, near: int = NEAR, files: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row.

    component_id is the smallest id reachable over fingerprints that differ in at
    most near bits, null if all ids there are null. Null and empty texts have no
    words, so fingerprint zero, linked like any other. Repeated rows share a
    component. Other columns are ignored. An empty table gives an empty one. files: of a table
    that a shuffle makes at most; as many as its partitions if None.
    """
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    buckets = buckets_for(docs, 4 << 20, 64)
    prints = cut(two.mapInArrow(_fingerprints(words_each), "doc_id long, fp long"), "prints")
    groups = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "groups", files)
    # what a skewed key could make large is joined with a written table only: such joins are split at run time
    linked = cut(groups.join(components(near_links(groups.select("fp"), buckets, near, files=files), files).withColumnRenamed("node", "fp"), "fp"), "linked", files)
    by_root = cut(linked.groupBy("root").agg(F.min("first").alias("component_id")), "roots", files)
    of_linked = linked.join(by_root, "root").select("fp", "component_id")
    alone = groups.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("first").alias("component_id"))
    of_print = cut(of_linked.unionByName(alone), "of_print", files)
    return prints.join(of_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
