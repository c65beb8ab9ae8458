"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Documents fall into cells (source, language, topic). Only cells with a named target
category or the rest of a dimension exist, so their number is a product of the
parameters' sizes, whatever the corpus; the token sums of cells are all that the
driver sees. Cell weights are scaled to one marginal after the other until all hold.
Probabilities come from the same fitting with no cell above 1, for the largest share
of the tokens for which it still meets all marginals: so as few documents as can be go.

Topics are clusters of documents by their words. A text becomes the sum of its words'
hashed vectors, each by the logarithm of its count; what is common to the documents of
its language is taken off, for that is no topic; k-means over all documents, from
fixed first directions, gives the clusters. Each round reads 128 bytes a document.
"""

from __future__ import annotations

import math
import warnings
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, once_a_worker, refuse, tidy

REST = "*"  # the category of all values without a target of their own
TOPICS, WIDTH, ROUNDS = 8, 64, 4
CACHE = 100_000  # words whose vectors a worker keeps
FAR = 1e12  # a weight above it is no solution


class WordVectors(dict):
    """Word -> its vector's places, each with a sign in the lowest bit: two of WIDTH, as one number, the first times 2 * WIDTH and the second."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode(errors="replace"), 7)
        places = h % (2 * WIDTH) * (2 * WIDTH) + (h >> 32) % (2 * WIDTH)
        if len(self) >= CACHE:
            self.clear()
        if len(word) < 40:
            self[word] = places
        return places


def measure(text: str | None, words: WordVectors) -> tuple[int, np.ndarray]:
    """Tokens (words), and the text's vector of length 1 (0 without words), in half precision."""
    own = (text or "").lower().split()
    counts = Counter(own)
    if not counts:
        return 0, np.zeros(WIDTH, np.float16)
    places = np.fromiter(map(words.__getitem__, counts), np.int64, len(counts))
    at = np.empty((len(counts), 2), np.int64)
    np.divmod(places, 2 * WIDTH, out=(at[:, 0], at[:, 1]))
    weight = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
    both = np.bincount(at.ravel(), weight.repeat(2), 2 * WIDTH)
    vector = both[::2] - both[1::2]
    return len(own), (vector / (math.sqrt(vector @ vector) or 1)).astype(np.float16)


def nearest(vectors: np.ndarray, language: np.ndarray, means: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of each vector the topic: the centre of the largest product with what is left after its language's mean."""
    return np.argmax((vectors.astype(np.float32) - means[language]) @ centres.T, axis=1)


def _measured(text_col: str) -> Column:
    """Struct of tokens and vector of a text; only texts go through Python."""

    def run(texts: pa.Array) -> pa.Array:
        words = once_a_worker("word vectors", WordVectors)
        found = [measure(t.as_py(), words) for t in texts]
        tidy()
        tokens, vectors = pa.array([f[0] for f in found], pa.int64()), pa.array([f[1].tobytes() for f in found], pa.binary())
        return pa.StructArray.from_arrays([tokens, vectors], names=["tokens", "vector"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<tokens: bigint, vector: binary>")(F.col(f"`{text_col}`").cast("string"))


def _placed(text_col: str, language: Column, means: np.ndarray, centres: np.ndarray) -> Column:
    """Struct of tokens and topic of a text: measured and placed by one function, so a task has one worker."""

    def run(texts: pa.Array, language: pa.Array) -> pa.Array:
        words = once_a_worker("word vectors", WordVectors)
        found = [measure(t.as_py(), words) for t in texts]
        tidy()
        vectors = np.array([f[1] for f in found], np.float16).reshape(-1, WIDTH)
        topics = nearest(vectors, language.to_numpy(zero_copy_only=False), means, centres)
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f"t{k}" for k in topics.tolist()], pa.string())], names=["tokens", "topic"])

    run.__annotations__ = {"texts": pa.Array, "language": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<tokens: bigint, topic: string>")(F.col(f"`{text_col}`").cast("string"), language)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, WIDTH)


def _sums(vectors: DataFrame, languages: int, means: np.ndarray, centres: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """By topic (all are 0 without centres) and language: the vectors' sums, and how many they are."""
    topics = 1 if centres is None else len(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((topics * languages, WIDTH + 1))
        for batch in batches:
            language, v = batch.column(0).to_numpy(), _vectors(batch.column(1))
            topic = np.zeros(len(v), np.int64) if centres is None else nearest(v, language, means, centres)
            for c in np.unique(topic * languages + language).tolist():
                mine = topic * languages + language == c
                total[c, :WIDTH] += v[mine].sum(axis=0, dtype=np.float64)
                total[c, WIDTH] += mine.sum()
        at = np.flatnonzero(total[:, WIDTH])
        place = (at[:, None] * (WIDTH + 1) + np.arange(WIDTH + 1)).ravel()
        yield pa.record_batch([pa.array(place), pa.array(total[at].ravel())], names=["place", "value"])

    rows = vectors.select("language", "vector").mapInArrow(run, "place long, value double")
    out = np.zeros(topics * languages * (WIDTH + 1))
    # as decimals: the sum is the same in whatever order tasks end
    for r in rows.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,9)")).alias("value")).collect():
        out[r.place] = float(r.value)
    out = out.reshape(topics, languages, WIDTH + 1)
    return out[:, :, :WIDTH], out[:, :, WIDTH]


def topics_of(vectors: DataFrame, languages: int, topics: int = TOPICS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The languages' means and the topics' centres, of a table (language: int, vector: binary); all its rows count in each round."""
    total, n = _sums(vectors, languages, np.zeros((languages, WIDTH), np.float32), None)
    means = np.divide(total[0], n[0][:, None], out=np.zeros_like(total[0]), where=n[0][:, None] > 0).astype(np.float32)
    centres = np.random.default_rng(11).normal(size=(topics, WIDTH)).astype(np.float32)
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    for _ in range(rounds):
        total, n = _sums(vectors, languages, means, centres)
        moved = (total - n[:, :, None] * means).sum(axis=1)
        length = np.linalg.norm(moved, axis=1, keepdims=True)
        centres = np.where(length > 0, moved / np.maximum(length, 1e-12), centres).astype(np.float32)
    return means, centres


def goals(observed: np.ndarray, targets: list[np.ndarray]) -> list[np.ndarray]:
    """Token shares of each axis' categories; targets of categories that nothing was observed in are shared among the others."""
    out, total = [], observed.sum()
    for k, t in enumerate(targets):
        have = observed.sum(axis=_others(observed, k))
        g = np.where(have > 0, t, 0.0)
        out.append(g / g.sum() if g.sum() else have / total)
    return out


def _others(x: np.ndarray, k: int) -> tuple[int, ...]:
    return tuple(j for j in range(x.ndim) if j != k)


def rake(observed: np.ndarray, targets: list[np.ndarray], rounds: int = 500, tolerance: float = 1e-10) -> np.ndarray:
    """observed scaled so that its sum over all axes but k is proportional to targets[k], for each k."""
    fitted = observed.astype(np.float64).copy()
    total = fitted.sum()
    if not total:
        return fitted
    wanted = [g * total for g in goals(fitted, targets)]
    for _ in range(rounds):
        worst = 0.0
        for k, goal in enumerate(wanted):
            have = fitted.sum(axis=_others(fitted, k))
            scale = np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)
            worst = max(worst, float(np.abs(scale[goal > 0] - 1).max(initial=0)))
            fitted *= np.expand_dims(scale, _others(fitted, k))
        if worst < tolerance:
            break
    else:
        warnings.warn(f"the targets can't all be met: after {rounds} rounds a marginal is off by {worst:.2g} of its target", stacklevel=2)
    return fitted


def _factor(weight: np.ndarray, tokens: np.ndarray, goal: float) -> float:
    """s with the sum of tokens * min(1, s * weight) equal to goal; without one, the s that takes all."""
    order = np.argsort(-weight)
    w, t = weight[order], tokens[order]
    rest = np.cumsum((w * t)[::-1])[::-1]  # of the cells from here on
    full = np.r_[0.0, np.cumsum(t)[:-1]]  # of the cells before, all taken
    s = (goal - full) / rest
    fits = np.flatnonzero(s * w <= 1)
    return float(s[fits[0]]) if len(fits) else float(1 / w[-1])


def probabilities(observed: np.ndarray, targets: list[np.ndarray], rounds: int = 300, tolerance: float = 1e-6) -> np.ndarray:
    """Sampling probability of each cell: with it the expected tokens meet the targets, and as many are kept as can be.

    Bounded raking (Deville and Saerndal, 1992) at a kept share that is found by
    halving; raked weights over their largest are the start, which is always within
    bounds. Cells without tokens get 1.
    """
    observed = observed.astype(np.float64)
    fitted = rake(observed, targets)
    weight = np.divide(fitted, observed, out=np.zeros_like(fitted), where=observed > 0)
    if not weight.max(initial=0):
        return np.ones_like(observed)
    shares, total = goals(observed, targets), observed.sum()

    def bounded(kept: float) -> np.ndarray | None:
        w = weight.copy()
        if any((share * kept * total > observed.sum(axis=_others(observed, k)) * (1 + tolerance)).any() for k, share in enumerate(shares)):
            return None
        for _ in range(rounds):
            worst = 0.0
            if w.max() > FAR:  # factors run away where the share can't be met
                return None
            for k, share in enumerate(shares):
                by, tokens = np.moveaxis(w, k, 0), np.moveaxis(observed, k, 0)
                for c, goal in enumerate(share * kept * total):
                    used = by[c] * tokens[c] > 0
                    if used.any():
                        worst = max(worst, abs((np.minimum(by[c], 1) * tokens[c]).sum() / goal - 1))
                        by[c] *= _factor(by[c][used], tokens[c][used], goal)
            if worst < tolerance:
                return np.minimum(w, 1)
        return None

    low, high = float(fitted.sum() / weight.max() / total), 1.0
    best = weight / weight.max()
    while high - low > 1e-4:
        middle = (low + high) / 2
        made = bounded(middle)
        low, high, best = (middle, high, made) if made is not None else (low, middle, best)
    return np.where(observed > 0, best, 1.0)


def mix(docs: DataFrame, targets: dict[str, dict[str, float]], text_col: str = "text", id_col: str = "doc_id", *, language_col: str = "lang", topics: int = TOPICS, seed: int = 17, with_text: bool = True) -> DataFrame:
    """docs with column _mix: struct of tokens, topic, weight, probability, sampled.

    targets names for each dimension (a column of docs, or "topic", measured from
    the text as t0, t1, ...) the token shares of its categories; the category "*" is
    the rest, null values among it, with what is left of 1 unless it is named. Where
    docs has language_col, topics are measured within its categories. weight is the
    cell's fitted over observed tokens; by probability the expected tokens meet the
    targets with as many documents as can be, and a document is sampled if the hash of
    its id and text, as a number from 0 to 1, is below it. So repeated rows are sampled
    alike. Documents without a token weigh nothing in the fit and have their cell's
    weight and probability, or 1 where the cell has no tokens. All columns of docs
    stay, but for the text unless with_text, which spares a second pass over the texts;
    _mix must not be one of them (ValueError). An empty table gives an empty one.
    Targets that can't all be met give a warning.
    """
    refuse(docs, "_mix")
    dims = list(targets)
    if not dims or any(not t for t in targets.values()):
        raise ValueError("each dimension needs targets")
    named = [[n for n in t if n != REST] for t in targets.values()]
    categories = [[*n, REST] for n in named]
    known = dict(zip(dims, named, strict=True)).get(language_col, [])

    def number(value: Column, names: list[str]) -> Column:
        """The value's place among the names, or that of the rest."""
        out = F.lit(len(names))
        for k, n in reversed(list(enumerate(names))):
            out = F.when(value == n, F.lit(k)).otherwise(out)
        return out

    plain = {d: number(F.col(f"`{d}`").cast("string"), n).alias(f"_c{k}") for k, (d, n) in enumerate(zip(dims, named, strict=True)) if d != "topic"}
    language = (number(F.col(f"`{language_col}`").cast("string"), known) if language_col in docs.columns else F.lit(0)).alias("language")
    keys = [f"_c{k}" for k in range(len(dims))]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if with_text or c != text_col]).alias("_row")
    drawn = (F.shiftrightunsigned(F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string"), F.lit(seed)), 11) / F.lit(float(1 << 53))).alias("_drawn")
    output = [] if with_text else [row, drawn]  # of a row: what the output has of it
    # narrow: categories, tokens and a vector of 128 bytes; the fit reads no text again
    narrow = cut(docs.select(*output, *plain.values(), language, _measured(text_col).alias("m")).select(*["_row", "_drawn"][: len(output)], *[c for c in keys if c in {f"_c{dims.index(d)}" for d in plain}], "language", "m.tokens", "m.vector"), "measured")
    means, centres = topics_of(narrow, len(known) + 1, topics) if "topic" in dims else (np.zeros((len(known) + 1, WIDTH), np.float32), np.zeros((1, WIDTH), np.float32))

    def topic(language: pa.Array, vector: pa.Array) -> pa.Array:
        return pa.array([f"t{k}" for k in nearest(_vectors(vector), language.to_numpy(zero_copy_only=False), means, centres).tolist()], pa.string())

    topic.__annotations__ = {"language": pa.Array, "vector": pa.Array, "return": pa.Array}
    topic_of = F.arrow_udf(topic, "string")
    of_topic = [number(F.col("topic"), n).alias(f"_c{k}") for k, (d, n) in enumerate(zip(dims, named, strict=True)) if d == "topic"]
    with_topic = narrow.withColumn("topic", topic_of("language", "vector")).select("*", *of_topic)
    observed = np.zeros([len(c) for c in categories])
    for r in with_topic.groupBy(*keys).agg(F.sum("tokens").alias("tokens")).collect():  # a row a cell
        observed[tuple(r[k] for k in keys)] = r.tokens
    wanted = [np.array([t.get(n, max(0.0, 1 - sum(t.values())) if n == REST else 0.0) for n in c]) for t, c in zip(targets.values(), categories, strict=True)]
    fitted = rake(observed, wanted)
    weight = np.divide(fitted, observed, out=np.ones_like(fitted), where=observed > 0)
    chance = probabilities(observed, wanted)
    table = [(*map(int, i), float(weight[i]), float(chance[i])) for i in np.ndindex(*observed.shape)]
    factors = docs.sparkSession.createDataFrame(table, ", ".join([f"{k} int" for k in keys] + ["_weight double", "_probability double"]))
    if with_text:
        measured = docs.select(row, drawn, *plain.values(), _placed(text_col, language, means, centres).alias("m")).select("*", "m.tokens", "m.topic").select("*", *of_topic)
    else:
        measured = with_topic
    joined = measured.join(F.broadcast(factors), keys)
    out = F.struct("tokens", "topic", F.col("_weight").alias("weight"), F.col("_probability").alias("probability"), (F.col("_drawn") < F.col("_probability")).alias("sampled"))
    return joined.select("_row", out.alias("_mix")).select("_row.*", "_mix")
