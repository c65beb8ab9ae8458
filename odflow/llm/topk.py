"""Exact top-k by integer inner product with a three-phase uniform threshold.

After TPUT (Cao and Wang, 2004). A score is a sum over blocks of dimensions, one
score list a block. Rows and queries are packed into blocks of some thousand vectors,
and each block of queries meets each block of rows.

1. Each task forms the products of one block of dimensions only, the one that holds
   most of the vectors' length, and gathers each query's best entries there with
   their exact scores. Of all tasks' entries the k-th best score is a safe cutoff, as
   k rows reach it.
2. Each block of queries carries its cutoffs. An entry is sufficient if its score so
   far and the most that its other blocks can add (the product of the two vectors'
   remaining lengths) reach the cutoff. That bound is never above what the uniform
   share of the cutoff, in one block at least, would ask for, and it spares products.
3. The remaining blocks of sufficient entries are resolved one after the other, each
   only for entries that still are, and exactly.

Nothing but the plan passes the driver. Blocks of queries are broadcast only if Spark
finds their written table small enough, else the two tables of blocks meet partition
by partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tidy

EXACT = 1 << 53  # floats hold all integers below
LEAST, MOST = -(1 << 63), (1 << 63) - 1  # scores beyond a long count as its ends
FAR = 1e300  # components beyond it count as it: their scores are beyond a long anyway
ROWS, QUERIES, HELD = 4096, 512, 1 << 18


def _blocks(size: int):
    """Vectors by length in blocks: ids and floor(256 * x) as whole floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, {}

        def block(width: int) -> pa.RecordBatch:
            nonlocal made
            ids, vectors = (np.concatenate(c) for c in zip(*held.pop(width), strict=True))
            made += 1
            return pa.record_batch([pa.array([(part << 32) + made]), pa.array([width]), pa.array([ids.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], names=["block", "width", "ids", "vectors"])

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            lengths, flat = np.asarray(lists.value_lengths()), np.floor(256.0 * np.clip(lists.flatten().to_numpy(zero_copy_only=False), -FAR, FAR))
            starts = np.cumsum(lengths) - lengths
            for width in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == width)
                own = flat[starts[rows, None] + np.arange(width)]
                for a in range(0, len(rows), size):
                    have = held.setdefault(width, [])
                    have.append((ids[rows[a : a + size]], own[a : a + size]))
                    if sum(len(i) for i, _ in have) >= size:
                        yield block(width)
        for width in list(held):
            yield block(width)

    return run


BLOCK = "block long, width long, ids binary, vectors binary"


def dimension_blocks(q: np.ndarray, c: np.ndarray, blocks: int) -> list[np.ndarray]:
    """The dimensions in blocks, those that hold most of the vectors' length first."""
    order = np.argsort(-(np.square(q).sum(axis=0) * np.square(c).sum(axis=0)), kind="stable")
    return [x for x in np.array_split(order, blocks) if len(x)] or [order]


def _huge(q: np.ndarray, c: np.ndarray) -> np.ndarray | None:
    """All scores by Python integers where floats would not be exact, else None."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < EXACT:
        return None
    whole = [np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) for x in (q, c)]
    return np.minimum(np.maximum(whole[0] @ whole[1].T, LEAST), MOST)


def best_entries(q: np.ndarray, c: np.ndarray, k: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase one: (query, row, exact score) of each query's k + 1 best rows by the first block of dimensions."""
    n, total = min(k + 1, len(c)), _huge(q, c)  # one more: a query's own row takes no part
    if total is not None:
        row = np.argsort(total, axis=1)[:, -n:]
        return np.repeat(np.arange(len(q)), n), row.ravel(), np.take_along_axis(total, row, 1).ravel()
    first = dimension_blocks(q, c, blocks)[0]
    row = np.argpartition(q[:, first] @ c[:, first].T, len(c) - n, axis=1)[:, -n:]
    return np.repeat(np.arange(len(q)), n), row.ravel(), np.einsum("qd,qnd->qn", q, c[row]).ravel()


def resolve(q: np.ndarray, c: np.ndarray, cutoff: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Phases two and three: (query, row, exact score) of all entries that reach the cutoffs, and how many products of components were formed."""
    total = _huge(q, c)
    if total is not None:
        at, row = np.nonzero(total >= np.array([LEAST if np.isneginf(x) else int(x) for x in cutoff], object)[:, None])
        return at, row, total[at, row], q.size * len(c)
    parts = dimension_blocks(q, c, blocks)
    # lengths of what is left after each part, rounded up
    rest = [[np.sqrt(np.square(x[:, np.concatenate(parts[j + 1 :])]).sum(axis=1)) * (1 + 1e-9) if parts[j + 1 :] else np.zeros(len(x)) for j in range(len(parts))] for x in (q, c)]
    score = q[:, parts[0]] @ c[:, parts[0]].T
    formed = len(q) * len(c) * len(parts[0])
    at, row = np.nonzero(score + rest[0][0][:, None] * rest[1][0] >= cutoff[:, None])
    own = score[at, row]
    for j, part in enumerate(parts[1:], 1):
        if 4 * len(at) > score.size:  # most are left: whole matrices are quicker than single entries
            own = own + (q[:, part] @ c[:, part].T)[at, row]
            formed += len(q) * len(c) * len(part)
        else:
            more = [np.einsum("nd,nd->n", q[at[a : a + HELD, None], part], c[row[a : a + HELD, None], part]) for a in range(0, len(at), HELD)]
            own = own + np.concatenate(more) if more else own
            formed += len(at) * len(part)
        left = own + rest[0][j][at] * rest[1][j][row] >= cutoff[at]
        at, row, own = at[left], row[left], own[left]
    return at, row, own, formed


def _merge(k: int, blocks: int, resolved: bool):
    """Of pairs of blocks: each query's k best entries in this task."""
    names = ["block", "query", "query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def best() -> np.ndarray:
            x = np.concatenate(held) if held else np.empty((0, 5), np.int64)
            x = x[np.lexsort((x[:, 3], ~x[:, 4], x[:, 1], x[:, 0]))]
            new = np.r_[True, (x[1:, :2] != x[:-1, :2]).any(axis=1)][: len(x)]
            place = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0)) if len(x) else np.empty(0, int)
            return x[place < k]

        def batch_of(x: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.ascontiguousarray(x[:, j])) for j in range(5)], names=names)

        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda name: batch.column(batch.schema.get_field_index(name))[r].as_py()  # noqa: B023, E731
                width = get("width")
                if width != get("q_width"):
                    continue
                q_ids, c_ids = np.frombuffer(get("q_ids"), np.int64), np.frombuffer(get("ids"), np.int64)
                q, c = np.frombuffer(get("q_vectors")).reshape(len(q_ids), width), np.frombuffer(get("vectors")).reshape(len(c_ids), width)
                if resolved:
                    cutoff = np.full(len(q_ids), -np.inf)
                    for x in get("cutoffs") or ():
                        cutoff[x["query"]] = float(x["score"])
                    cutoff = np.where(np.abs(cutoff) < EXACT, cutoff, np.nextafter(cutoff, -np.inf))  # as a float it may be above
                    at, row, score, _ = resolve(q, c, cutoff, blocks)
                else:
                    at, row, score = best_entries(q, c, k, blocks)
                other = q_ids[at] != c_ids[row]
                at, row, score = at[other], row[other], score[other].astype(np.int64)
                held.append(np.c_[np.full(len(at), get("q_block")), at, q_ids[at], c_ids[row], score])
                size += len(at)
                if size > HELD:
                    held = [best()]
                    size = len(held[0])
                    if 2 * size > HELD:
                        yield batch_of(held[0])
                        held, size = [], 0
        yield batch_of(best())
        tidy()

    return run


ENTRY = "block long, query long, query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", dim_blocks: int = 4) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k rows of largest integer inner product.

    Ties go to the smaller id; fewer than k rows give all. Rows with a null id or
    vector, or a null or non-finite component, take no part, as query or as
    candidate. Vectors meet those of their own length only. Rows that share the
    query's id are not its candidates; repeated other rows each count. A repeated
    query row is one query. Scores beyond a long are cut to its range. Other columns
    are ignored. An empty table gives an empty one.
    """
    clean = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    clean = clean.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & usable)
    rows = cut(clean.select("vec_id", "v").mapInArrow(_blocks(ROWS), BLOCK), "rows")
    asked = cut(clean.where("asks").select("vec_id", "v").dropDuplicates().mapInArrow(_blocks(QUERIES), BLOCK), "queries")
    named = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns])
    lists = cut(rows.crossJoin(named).mapInArrow(_merge(k, dim_blocks, False), ENTRY), "lists")
    by_score = Window.partitionBy("block", "query").orderBy(F.desc("score"), "vec_id")
    kth = lists.withColumn("place", F.row_number().over(by_score)).where(F.col("place") == k)
    cutoffs = kth.groupBy(F.col("block").alias("q_block")).agg(F.collect_list(F.struct("query", "score")).alias("cutoffs"))  # a block has at most QUERIES
    with_cutoffs = cut(named.join(cutoffs, "q_block", "left"), "cutoffs")
    found = rows.crossJoin(with_cutoffs).mapInArrow(_merge(k, dim_blocks, True), ENTRY)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
