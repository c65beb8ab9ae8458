"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A token is coded as binary decisions: whether it is the word that followed the last
two words before in this text, and the bits of its code. A code is one of 64 leaves:
the unknown word, the end, the 14 words that are most frequent in the training texts,
and three bands of frequency with 16 leaves each, by four bits of the word itself.
Each decision has several predictions, from counts of the training texts under hashed
contexts (none, one and two codes before, the word before) and from this text so far.
Weights, one set for each decision (the gate), combine them in the logistic domain and
learn after every token; an adaptive map from the mixed probability to the observed
one refines it.

If m is the probability of the foretold word and c that of a word's code times the
word's share of its leaf's count, a word has the probability (1 - m) c, and m more if
it is the foretold one: these sum to 1 over all known words, the unknown and the end.

Word counts come from all training texts: blocks count their words, counts meet by
word hash and return to the blocks. Only tables of a fixed size are broadcast.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, cut, runs, tidy

UNKNOWN, END, FIRST = 0, 1, 2  # leaves; from FIRST on the most frequent words
TOP, BANDS, OWN = 14, 3, 16
BAND = FIRST + TOP  # the first leaf of the bands
CODE_BITS = 6
DECISIONS = 1 + CODE_BITS
NODES = 1 << CODE_BITS  # node 0 is the match decision, 1.. the code tree
OCTAVES = 64
CONTEXTS, SLOTS = 4, 1 << 18
INPUTS = CONTEXTS + 1
LANES = 1024
BLOCK_TOKENS = 1_500_000
FAN_IN = 64  # tables that one task adds up
_M = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.uint64(0xFFFFF)  # bits of a word's hash that are kept as context; the highest four are its own bits


def _pack(**arrays) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, protocol=5), 3)


def _unpack(blob: bytes) -> dict:
    return pickle.loads(zstandard.decompress(blob))


class _Local(dict):
    """Word -> number in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _count(buckets: int):
    """Blocks of encoded texts, and by hash range each block's words with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        words, texts, ids, train, size, total = _Local(), [], [], [], [], 0

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal words, texts, ids, train, size, total, k
            name = (part << 32) + k
            lens = np.array([len(t) for t in texts], np.int64)
            codes = np.concatenate(texts) if texts else np.empty(0, np.int32)
            learn = np.array(train, bool)
            counts = np.bincount(codes[np.repeat(learn, lens)], minlength=len(words)).astype(np.uint32)
            digest = xxhash.xxh64_intdigest
            hashes = np.array([digest(w) for w in words], np.uint64)
            bucket = hashes >> np.uint64(32)
            bucket %= np.uint64(buckets)
            order = np.lexsort((hashes, bucket))
            used, cuts = runs(bucket[order])
            used = used.astype(np.int64)
            null = np.array([i is None for i in ids], bool)
            own = np.array([0 if i is None else i for i in ids], np.int64)
            body = _pack(ids=own, null=null, train=learn, lens=lens, bytes=np.array(size, np.int64), codes=codes, order=order.astype(np.int32), used=used, cuts=cuts, low=(hashes & _WORD).astype(np.uint32))
            data = [_pack(h=hashes[order[a:b]], n=counts[order[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.record_batch([pa.array([-1, *used], pa.int64()), pa.array([name] * (len(used) + 1), pa.int64()), pa.array([body, *data], pa.binary())], names=["bucket", "block", "data"])
            words, texts, ids, train, size, total, k = _Local(), [], [], [], [], 0, k + 1

        for batch in batches:
            for i, learn, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                codes = np.fromiter(map(words.__getitem__, raw.lower().split()), np.int32)
                ids.append(i)
                train.append(learn)
                texts.append(codes)
                size.append(len(raw))
                total += len(codes) + 1
                if total >= BLOCK_TOKENS:
                    yield from block()
        if ids:
            yield from block()
        tidy()

    return run


def _octave(counts: np.ndarray) -> np.ndarray:
    """Binary logarithm of positive counts, rounded down."""
    return np.frexp(counts.astype(np.float64))[1] - 1


def _merge(rows: pa.Table) -> pa.Table:
    """Of a hash range: each block's words' counts in all training texts; counts' sums by octave and own bits, the number of words, and the largest counts."""
    blocks = rows.column("block").to_pylist()
    parts = [_unpack(x) for x in rows.column("data").to_pylist()]
    words, where = np.unique(np.concatenate([p["h"] for p in parts]), return_inverse=True)
    total = np.bincount(where, np.concatenate([p["n"] for p in parts]), len(words)).astype(np.int64)
    cuts = np.cumsum([0] + [len(p["h"]) for p in parts])
    data = [_pack(n=total[where[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]
    known = total > 0
    own = (words[known] & _WORD).astype(np.int64) >> 16
    kinds = _octave(total[known]) * OWN + own
    first = np.argsort(-total[known], kind="stable")[: 2 * TOP]
    sums = _pack(words=int(known.sum()), counts=np.bincount(kinds, total[known], OCTAVES * OWN), top=np.c_[total[known][first], own[first]])
    bucket = rows.column("bucket")[0].as_py()
    n = len(blocks)
    return pa.table({"bucket": pa.array([bucket] * n + [-1], pa.int64()), "block": pa.array([*blocks, -1], pa.int64()), "data": pa.array([*data, sums], pa.binary())})


class Code:
    """Leaves of words by their training counts and own bits, and the leaves' counts.

    A word that is among the most frequent is known by its count, so words of equal
    counts are not.
    """

    def __init__(self, counts: np.ndarray, top: np.ndarray, ends: int):
        """counts: by octave and own bits; top: rows (count, own bits) with at least all words that are as frequent as the most frequent 2 * TOP."""
        top = top[np.argsort(-top[:, 0], kind="stable")][: 2 * TOP]
        value, first, times = np.unique(top[:, 0], return_index=True, return_counts=True)
        lone = first[(times == 1) & (value > top[-1, 0] if len(top) == 2 * TOP else times == 1)][::-1][:TOP]
        self.top = top[lone, 0].astype(np.int64)
        rest = counts.reshape(OCTAVES, OWN).astype(np.float64).copy()
        for n, own in top[lone].tolist():
            rest[int(np.frexp(float(n))[1]) - 1, int(own)] -= n
        below = np.cumsum(rest.sum(axis=1))  # equal thirds, by octaves
        self.band = np.minimum((below - rest.sum(axis=1) / 2) * BANDS // max(below[-1], 1), BANDS - 1).astype(np.int64)
        self.share = np.zeros(NODES)
        self.share[FIRST : FIRST + len(lone)] = self.top
        self.share[END] = ends
        np.add.at(self.share, BAND + self.band[:, None] * OWN + np.arange(OWN), rest)
        full = np.r_[np.zeros(NODES, bool), self.share > 0]  # nodes of the tree, then leaves
        full[NODES + UNKNOWN] = full[NODES + END] = True
        for node in range(NODES - 1, 0, -1):
            full[node] = full[2 * node] | full[2 * node + 1]
        self.forks = np.r_[True, full[2::2][: NODES - 1] & full[3::2][: NODES - 1]]  # where either bit can be; elsewhere it goes without saying

    def leaves(self, counts: np.ndarray, low: np.ndarray) -> np.ndarray:
        out = BAND + self.band[np.where(counts > 0, _octave(np.maximum(counts, 1)), 0)] * OWN + (low.astype(np.int64) >> 16)
        for k, n in enumerate(self.top.tolist()):
            out[counts == n] = FIRST + k
        return np.where(counts > 0, out, UNKNOWN).astype(np.uint8)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = x * _M
    return x ^ (x >> np.uint64(32))


def _decisions(x: dict, index: np.ndarray, place: np.ndarray) -> dict[str, np.ndarray]:
    """Slots (tokens, decisions, contexts), node numbers, bits, and which decisions are made, of the tokens at index.

    x: leaves and low (20 bits of the word's hash) of all tokens, match (-1: no word
    is foretold, else if it was right) and run; place is the token's in its text.
    The bits of a code are only learned from (made) where no word was foretold rightly.
    """
    n = len(index)
    c = x["leaves"][index].astype(np.int64)
    one, two = np.maximum(index - 1, 0), np.maximum(index - 2, 0)
    before = np.where(place > 0, x["leaves"][one].astype(np.int64) + 1, 0)
    before2 = np.where(place > 1, x["leaves"][two].astype(np.int64) + 1, 0)
    word = np.where(place > 0, x["low"][one].astype(np.int64) + 1, 0)
    streak, match = np.minimum(x["run"][index].astype(np.int64), 31), x["match"][index]
    shifts = np.arange(CODE_BITS - 1, -1, -1)
    bits = np.empty((n, DECISIONS), np.uint8)
    bits[:, 0] = match > 0
    bits[:, 1:] = c[:, None] >> shifts & 1
    nodes = np.zeros((n, DECISIONS), np.int64)
    nodes[:, 1:] = (1 << np.arange(CODE_BITS)) | (c[:, None] >> (shifts + 1))
    made = np.empty((n, DECISIONS), bool)
    made[:, 0] = match >= 0
    made[:, 1:] = (match <= 0)[:, None]
    slots = np.empty((n, DECISIONS, CONTEXTS), np.int64)  # of all contexts' tables, one after the other
    slots[:, :, 0] = nodes
    np.add(nodes, (before * NODES + SLOTS)[:, None], out=slots[:, :, 1])
    spread = nodes.view(np.uint64) * np.uint64(0x94D049BB133111EB)
    for k, key in ((2, before * 128 + before2), (3, word)):
        h = _mix64(key.astype(np.uint64) + np.uint64(k << 32))
        x = h[:, None] + spread
        x *= _M
        x ^= x >> np.uint64(32)
        x >>= np.uint64(46)
        np.add(x.view(np.int64), k * SLOTS, out=slots[:, :, k])
    slots[:, 0, 1], slots[:, 0, 2] = streak * NODES + SLOTS, streak * 128 + before + 2 * SLOTS  # the match decision looks at how long matches went on
    return {"slots": slots, "nodes": nodes, "bits": bits, "made": made}


def _foretold(codes: np.ndarray, symbols: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token: is its symbol the one that followed the last two tokens before (-1: they are new), and for how long that went on."""
    n = len(codes)
    match = np.full(n, -1, np.int8)
    run = np.zeros(n, np.uint8)
    if n < 3:
        return match, run
    at = np.flatnonzero(place >= 2)
    key = _mix64(_mix64(codes[at - 1].astype(np.uint64) + np.uint64(1)) + _mix64(codes[at - 2].astype(np.uint64) + (doc[at].astype(np.uint64) + np.uint64(1) << np.uint64(32))))  # no two words change places
    order = np.argsort(key, kind="stable")
    same = np.r_[False, key[order][1:] == key[order][:-1]]
    later, earlier = at[order[same]], at[order[np.flatnonzero(same) - 1]]
    real = (codes[later - 1] == codes[earlier - 1]) & (codes[later - 2] == codes[earlier - 2]) & (doc[later] == doc[earlier])
    later, earlier = later[real], earlier[real]
    match[later] = symbols[later] == symbols[earlier]
    hit = match > 0
    reset = np.maximum.accumulate(np.where(~hit, np.arange(n), -1))
    length = np.arange(n) - reset
    run[1:] = np.minimum(length[:-1], 255)
    run[place == 0] = 0
    return match, run


def _code(slices: int, groups: int, totals: dict):
    """Coded texts of a block with base scores, and the block's context counts, in slices."""
    code, tokens, types, ends = totals["code"], totals["tokens"], totals["types"], totals["ends"]

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        schema = pa.schema({"slice": pa.int64(), "grp": pa.int64(), "data": pa.binary()})
        if not rows.num_rows:
            return schema.empty_table()
        x = _unpack(rows.column("data")[0].as_py())
        counts = np.zeros(len(x["order"]), np.int64)
        for k, blob in zip(np.searchsorted(x["used"], found.column("bucket").to_numpy()).tolist(), found.column("data").to_pylist(), strict=True):
            counts[x["order"][x["cuts"][k] : x["cuts"][k + 1]]] = _unpack(blob)["n"]
        lens = x["lens"] + 1  # with the end
        n, docs = int(lens.sum()), len(lens)
        last = np.cumsum(lens) - 1
        word = np.ones(n, bool)
        word[last] = False
        codes = np.full(n, len(counts), np.int64)
        codes[word] = x["codes"]
        doc = np.repeat(np.arange(docs), lens)
        place = np.arange(n) - np.repeat(last - lens + 1, lens)
        of_code = np.r_[counts, ends]
        leaf_of = np.r_[code.leaves(counts, x["low"]), np.uint8(END)]
        with np.errstate(divide="ignore", invalid="ignore"):
            inner = np.where(leaf_of >= FIRST, np.log(of_code / code.share[leaf_of]), 0.0).astype(np.float32)
        base = np.log10((of_code + 1) / (tokens + types + 1))
        match, streak = _foretold(codes, np.where(leaf_of[codes] == UNKNOWN, -1, codes), doc, place)
        first = last - lens + 1
        leaves, low = leaf_of[codes], np.r_[x["low"], np.uint32(0)][codes]
        coded = _pack(
            ids=x["ids"], null=x["null"], train=x["train"], bytes=x["bytes"], lens=lens, codes=codes.astype(np.int32), leaf_of=leaf_of, low_of=np.r_[x["low"], np.uint32(0)], inner_of=inner, match=match, run=streak,
            base=np.add.reduceat(base[codes], first), known=np.add.reduceat((of_code[codes] > 0).astype(np.int64), first),
        )
        table = np.zeros(CONTEXTS * SLOTS * 2, np.int64)
        learned, seen = np.flatnonzero(np.repeat(x["train"], lens)), []
        tokens_at = {"leaves": leaves, "low": low, "match": match, "run": streak}
        for a in range(0, len(learned), 12_000):  # few enough to stay in the cache; counted some at a time
            index = learned[a : a + 12_000]
            d = _decisions(tokens_at, index, place[index])
            use = d["made"] & code.forks[d["nodes"]]
            seen.append((d["slots"][use] * 2 + d["bits"][use][:, None]).ravel())
            if len(seen) == 10 or a + 12_000 >= len(learned):
                table += np.bincount(np.concatenate(seen), minlength=len(table))
                seen = []
        table = table.reshape(-1, 2).T
        group = int(rows.column("block")[0].as_py()) * 0x9E3779B1 % groups
        parts = np.split(table, slices, axis=1)
        return pa.table({"slice": [-1, *range(slices)], "grp": [group] * (slices + 1), "data": [coded, *[_pack(t=p.astype(np.uint32)) for p in parts]]}, schema=schema)

    return run


def _add(rows: pa.Table) -> pa.Table:
    total = sum(_unpack(b)["t"].astype(np.int64) for b in rows.column("data").to_pylist())
    return pa.table({"slice": rows.column("slice").slice(0, 1), "grp": rows.column("grp").slice(0, 1), "data": pa.array([_pack(t=total)], pa.binary())})


def _stretch(table: np.ndarray) -> np.ndarray:
    return np.clip(np.log((table[1] + 0.4) / (table[0] + 0.4)), -8, 8).astype(np.float32)


APM_BINS = 17  # of the logit from -8 to 8


def mix_texts(x: dict, stretched: np.ndarray, forks: np.ndarray, rate: float = 0.02, own_rate: float = 0.06, map_rate: float = 0.03) -> np.ndarray:
    """ln of the probability of each text. Texts run side by side, longest first; each is on its own."""
    lens = x["lens"]
    out = np.zeros(len(lens))
    firsts = np.cumsum(lens) - lens
    by_size = np.argsort(-lens, kind="stable")
    at = 0
    while at < len(by_size):
        lanes = by_size[at : at + LANES]
        wide = int(np.searchsorted(np.cumsum(lens[lanes]), 600_000)) + 1  # bounds the inputs held at once
        lanes = lanes[:wide]
        at += len(lanes)
        out[lanes] = _lockstep(x, firsts[lanes], lens[lanes], stretched, forks, rate, own_rate, map_rate)
    return out


def _lockstep(x: dict, first: np.ndarray, lens: np.ndarray, stretched: np.ndarray, forks: np.ndarray, rate: float, own_rate: float, map_rate: float) -> np.ndarray:
    n_lanes, longest = len(first), int(lens[0])
    alive = np.searchsorted(-lens, -np.arange(1, longest + 1), side="right")  # lanes with a token at each step
    weights = np.full((n_lanes, DECISIONS, INPUTS), 0.25, np.float32)
    own = np.full(n_lanes * NODES, 0.0, np.float32)  # logits of this text's own counts
    refine = np.tile(np.linspace(-8, 8, APM_BINS, dtype=np.float32), n_lanes * DECISIONS)
    total = np.zeros(n_lanes)
    lane = np.arange(n_lanes)[:, None]
    gates = (lane * DECISIONS + np.arange(DECISIONS)) * APM_BINS  # where a lane's map of a decision begins
    step = 0
    while step < longest:  # some tokens of all lanes at a time: their inputs are gathered together
        m = int(alive[step])
        span = max(1, min(longest - step, 60_000 // m))
        steps = step + np.arange(span)
        index = np.minimum(first[:m, None] + steps, (first + lens - 1)[:m, None]).ravel()
        place = np.broadcast_to(steps, (m, span)).ravel()
        d = _decisions(x, index, place)
        st = stretched.ravel().take(d["slots"]).reshape(m, span, DECISIONS, CONTEXTS)
        nodes, bits, made = (d[k].reshape(m, span, DECISIONS) for k in ("nodes", "bits", "made"))
        match, share = x["match"][index].reshape(m, span), np.exp(x["inner"][index].astype(np.float64)).reshape(m, span)
        told, hit = (match >= 0).astype(np.float32), (match > 0).astype(np.float32)
        fork = None if forks.all() else forks[nodes]
        made = made if fork is None else made & fork
        bits = bits.astype(np.float32)
        zeros = 1 - bits
        own_at = nodes + lane[:m, :, None] * NODES
        for t in range(span):
            a = int(alive[step + t])
            inputs = np.empty((a, DECISIONS, INPUTS), np.float32)
            inputs[:, :, :CONTEXTS] = st[:a, t]
            mine_at, bit, on = own_at[:a, t], bits[:a, t], made[:a, t]
            mine = own.take(mine_at)
            inputs[:, :, CONTEXTS] = mine
            logit = np.clip(np.einsum("ldk,ldk->ld", weights[:a], inputs), -8, 8)
            p = 1 / (1 + np.exp(-logit))
            error = np.where(on, bit - p, 0)
            weights[:a] += rate * error[:, :, None] * inputs
            spot = np.rint(logit * ((APM_BINS - 1) / 16) + (APM_BINS - 1) / 2).astype(np.int64)
            spot += gates[:a]
            seen = refine.take(spot)
            q = 1 / (1 + np.exp(-seen))
            refine[spot] = seen + map_rate * np.where(on, bit - q, 0)
            mixed = 0.75 * p + 0.25 * q
            right = np.abs(zeros[:a, t] - mixed)  # of what the bit is
            if fork is not None:
                right[~fork[:a, t]] = 1
            word = right[:, 1:].prod(axis=1) * share[:a, t]
            foretold = mixed[:, 0] * told[:a, t]
            total[:a] += np.log((1 - foretold) * word + foretold * hit[:a, t])
            fresh = 4 * own_rate * np.where(on, bit - 1 / (1 + np.exp(-mine)), 0)
            own[mine_at] = np.clip(mine + fresh, -8, 8)
        step += span
    return total


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def _score(stretched: np.ndarray, forks: np.ndarray, tokens: int):
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                x = _unpack(blob)
                x |= {name: x[f"{name}_of"][x["codes"]] for name in ("leaf", "low", "inner")}  # kept by word: smaller than by token
                x["leaves"] = x.pop("leaf")
                score = mix_texts(x, stretched, forks) / np.log(10)
                size = x["bytes"]
                per_byte = pa.array(-score * np.log2(10) / np.maximum(size, 1), mask=size == 0)
                yield pa.record_batch([pa.array(x["ids"], mask=x["null"]), pa.array(~x["train"]), pa.array(x["lens"]), pa.array(x["known"]), pa.array(np.full(len(score), tokens)), pa.array(x["base"]), pa.array(score), per_byte], names=names)
        tidy()

    return run


def score_texts(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base and mixed scores of all texts by models of those that are not held out.

    A null text is empty: one end. Rows with a null held_out are training texts.
    n_tokens counts the end. base_score is the add-one unigram score, score the log10
    of the mixed model's probability of the tokens, where all unknown words are one;
    bits_per_byte is its size in bits over the text's bytes, null for empty texts.
    Without training texts every word is unknown. An empty table gives an empty one.
    Repeated rows are each counted and score alike. Other columns are ignored.
    """
    three = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(~held_out, F.lit(True)).alias("train"), F.col(text_col).cast("string").alias("text"))
    buckets = buckets_for(docs, 2 << 20, 256)
    groups = buckets_for(docs, FAN_IN * (4 << 20), 1)
    slices = 16
    counted = cut(three.mapInArrow(_count(buckets), "bucket long, block long, data binary"), "counted")
    merged = cut(counted.where("bucket >= 0").groupBy("bucket").applyInArrow(_merge, "bucket long, block long, data binary"), "merged")
    words, counts, top = 0, np.zeros(OCTAVES * OWN), np.empty((0, 2))
    for r in merged.where("block < 0").toLocalIterator():  # a row a hash range
        x = _unpack(r.data)
        words, counts, top = words + x["words"], counts + x["counts"], np.r_[top, x["top"]]
        top = top[np.argsort(-top[:, 0], kind="stable")][: 2 * TOP]
    ends = three.where("train").count()
    totals = {"code": Code(counts, top, ends), "tokens": int(counts.sum()) + ends, "types": words + (ends > 0), "ends": ends}
    blocks, found = counted.where("bucket < 0").select("block", "data"), merged.where("block >= 0")
    coded = cut(blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_code(slices, groups, totals), "slice long, grp long, data binary"), "coded")
    sums = coded.where("slice >= 0")
    while True:  # a tree: each task adds up some tables
        sums = sums.groupBy("slice", "grp").applyInArrow(_add, "slice long, grp long, data binary")
        if groups == 1:
            break
        groups = -(-groups // FAN_IN)
        sums = sums.withColumn("grp", F.pmod("grp", F.lit(groups)))
    tables = sums.collect()  # of a fixed size
    table = np.concatenate([_unpack(r.data)["t"] for r in sorted(tables, key=lambda r: r.slice)], axis=1) if tables else np.zeros((2, CONTEXTS * SLOTS), np.int64)
    stretched = _stretch(table).reshape(CONTEXTS, SLOTS)
    return coded.where("slice < 0").select("data").mapInArrow(_score(stretched, totals["code"].forks, totals["tokens"]), RESULT)
