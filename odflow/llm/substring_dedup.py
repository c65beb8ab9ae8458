"""Removal of byte passages that an earlier document holds too.

A byte goes if it lies in a `length`-byte string that also starts in a document
with a smaller id. The plan never sorts all suffixes of the corpus at once:

1. Documents are packed into blocks of some parts of a few MB, written once. A part is
   worked on at a time; what it sends leaves once a block and bucket, and buckets grow
   with the input, so that parcels stay few.
2. Each block marks anchors: hashes of 25-byte strings that are the least within
   some 50-byte window. Equal windows mark equal anchors. Only the hashes, once a
   block, meet by hash range, so a common passage costs one number a block.
3. Blocks learn which of their anchors other documents share and send the 75 bytes
   around them. Identical surroundings collapse at once (all but the earliest are
   covered); different ones meet by anchor and are suffix-sorted (suffix_array) as
   strings over 5-byte symbols. Suffixes that share 45 bytes form classes, and the
   5 bytes left of each window are then compared byte by byte.
4. An anchor in more than `hot` documents is split: its windows meet by their own
   hash, one row a block and window, whatever the number of documents.
5. Blocks take back the covered ranges and cut them out.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, cut, runs, tidy
from .suffix_array import common_at_least, suffix_array

LENGTH, GRAM = 50, 25  # bytes of a repeat; of an anchor
STEPS = LENGTH - GRAM + 1  # anchor positions in a window, and windows around an anchor
SPAN = 2 * LENGTH - GRAM  # bytes around an anchor that its windows touch
SYMBOL = 5  # bytes of a suffix-array symbol
SIDE = GRAM // SYMBOL  # symbols on each side of the anchor, which is one symbol
PART_BYTES, PARTS = 4 << 20, 4  # of a part, and how many of them a block has
BUCKET_BYTES = 8 << 20  # input of a bucket, from 256 buckets on
PIECE = 8 << 20  # bytes whose hashes are formed at a time
_SIDES = np.r_[np.arange(GRAM), np.arange(2 * GRAM, SPAN)]  # what is sent of those: the anchor's hash stands for its bytes
NO_ID = (1 << 63) - 1  # a null id counts as larger than all ids
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _pack(**arrays: np.ndarray) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, protocol=5), 3)


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    return pickle.loads(zstandard.decompress(blob))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, ids, texts, size, parts, whole, k = TaskContext.get().partitionId(), [], [], 0, [], 0, 0

    def part() -> bytes:
        data = b"".join(texts)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        null = np.array([i is None for i in ids], bool)
        own = np.array([NO_ID if i is None else i for i in ids], np.int64)
        return _pack(ids=own, null=null, lens=lens, data=np.frombuffer(data, np.uint8))

    def block() -> pa.RecordBatch:
        return pa.record_batch({"block": pa.array([(task << 32) + k]), "data": pa.array([parts], pa.list_(pa.binary()))})

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_buffer()
            ids.append(i)
            texts.append(raw.to_pybytes() if raw is not None else b"")
            size += len(texts[-1])
            if size >= PART_BYTES or len(ids) >= 65536:
                parts.append(part())
                whole += size
                ids, texts, size = [], [], 0
                if whole >= PARTS * PART_BYTES or len(parts) >= PARTS:
                    yield block()
                    parts, whole, k = [], 0, k + 1
    if ids:
        parts.append(part())
    if parts:
        yield block()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _B
    return x ^ (x >> np.uint64(31))


def _anchors(data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors in the joined bytes of a block's documents, and their hashes (odd numbers); a long text goes piece by piece, with what its windows overlap."""
    n, ends = len(data), np.cumsum(lens)
    if n <= PIECE + 2 * SPAN:
        return _anchors_of(data, np.repeat(ends, lens))
    found = []
    for a in range(0, n, PIECE):
        low, high = max(0, a - SPAN), min(n, a + PIECE + SPAN)
        at, r = _anchors_of(data[low:high], ends[np.searchsorted(ends, np.arange(low, high), side="right")] - low)
        mine = (at + low >= a) & (at + low < a + PIECE)
        found.append((at[mine] + low, r[mine]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _anchors_of(data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _anchors, of one piece; end is of each byte's document."""
    n = len(data)
    if n < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = _mix((data.astype(np.uint64) + np.uint64(1)) * _A)
    w = 1
    while w * 2 <= GRAM:
        h = _mix(h[:-w] + h[w:] * _C)
        w *= 2
    m = n - GRAM + 1
    r = _mix(h[:m] + h[GRAM - w : GRAM - w + m] * _A) | np.uint64(1)
    low = r
    w = 1
    while w * 2 <= STEPS:
        low = np.minimum(low[:-w], low[w:])
        w *= 2
    k = m - STEPS + 1
    low = np.minimum(low[:k], low[STEPS - w : STEPS - w + k])
    low = np.where(np.arange(k) + LENGTH <= end[:k], low, np.uint64(0))  # 0: no window, it crosses documents
    pad = np.zeros(STEPS - 1, np.uint64)
    top = np.concatenate([pad, low, pad])
    w = 1
    while w * 2 <= STEPS:
        top = np.maximum(top[:-w], top[w:])
        w *= 2
    top = np.maximum(top[:m], top[STEPS - w : STEPS - w + m])
    at = np.flatnonzero(top == r)
    return at, r[at]


def _bucketed(hashes: np.ndarray, docs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unique (bucket, low half) keys of a block in order, in how many documents each is, its inverse, the buckets and their edges."""
    key = ((hashes >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))
    unique, inverse = np.unique(key, return_inverse=True)
    pairs = np.unique(inverse.astype(np.int64) << 32 | docs)
    count = np.bincount(pairs >> 32, minlength=len(unique))
    used, edges = runs(unique >> np.uint64(32))
    return unique, count, inverse, used.astype(np.int64), edges


def _located(data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of a part's anchors, their hashes, and their documents' numbers in the part."""
    at, h = _anchors(data, lens)
    return at, h, np.searchsorted(np.cumsum(lens), at, side="right")


def _hashes(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blobs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hashes, docs, before = [], [], 0
                for blob in blobs.as_py():
                    x = _unpack(blob)
                    _, h, doc = _located(x["data"], x["lens"])
                    hashes.append(h)
                    docs.append(doc + before)
                    before += len(x["lens"])
                unique, count, _, used, edges = _bucketed(np.concatenate(hashes), np.concatenate(docs), buckets)
                low, few = (unique & np.uint64(0xFFFFFFFF)).astype("<u4"), np.minimum(count, 65535).astype("<u2")
                yield pa.record_batch({
                    "bucket": pa.array(used, pa.int64()),
                    "block": pa.array([block] * len(used), pa.int64()),
                    "low": pa.array([low[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary()),
                    "docs": pa.array([few[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary()),
                })

    return run


def _flags(hot: int):
    """Of a bucket: for each block's hashes 0 if in one document only, 1 if shared, 2 if in more than hot documents."""

    def run(rows: pa.Table) -> pa.Table:
        blobs = rows.column("low").to_pylist()
        low = np.concatenate([np.frombuffer(x, "<u4") for x in blobs])
        docs = np.concatenate([np.frombuffer(x, "<u2") for x in rows.column("docs").to_pylist()]).astype(np.int64)
        order = np.argsort(low, kind="stable")
        first = np.flatnonzero(np.r_[True, low[order][1:] != low[order][:-1]])
        total = np.add.reduceat(docs[order], first)
        flag = np.empty(len(low), np.uint8)
        flag[order] = np.repeat((total > 1).astype(np.uint8) + (total > hot), np.diff(np.r_[first, len(low)]))
        cuts = np.cumsum([0] + [len(x) // 4 for x in blobs])
        return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "flags": pa.array([flag[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())})

    return run


def _around(data: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The SPAN bytes around anchors (0 where their document has none), and how many are the document's left and right of the anchor's start."""
    left, right = np.minimum(at - begin, GRAM), np.minimum(end - at, LENGTH)
    places = at[:, None] + np.arange(-GRAM, LENGTH)
    inside = (places >= begin[:, None]) & (places < end[:, None])
    return np.where(inside, data[np.clip(places, 0, len(data) - 1)], 0).astype(np.uint8), left, right


def _hash_rows(rows: np.ndarray, *also: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte rows and further numbers."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    h = np.full(len(rows), 0x51ED270B, np.uint64)
    for x in [*wide.view("<u8").T, *also]:
        h = (h ^ x.astype(np.uint64)) * _A
        h ^= h >> np.uint64(29)
    return _mix(h)


def _least(keys: tuple[np.ndarray, ...], ids: np.ndarray) -> np.ndarray:
    """The least id among the rows with equal keys, for each row."""
    if not len(ids):
        return ids
    order = np.lexsort((ids, *keys))
    new = np.zeros(len(ids), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty_like(ids)
    out[order] = ids[order][new][np.cumsum(new) - 1]
    return out


def _send(buckets: int):
    schema = pa.schema({"bucket": pa.int64(), "kind": pa.string(), "block": pa.int64(), "data": pa.binary()})

    def run(blocks: pa.Table, flags: pa.Table) -> pa.Table:
        if not blocks.num_rows or not flags.num_rows:
            return schema.empty_table()
        block, parts = blocks.column("block")[0].as_py(), [_unpack(p) for p in blocks.column("data")[0].as_py()]
        found = [_located(x["data"], x["lens"]) for x in parts]
        before = np.cumsum([0] + [len(x["lens"]) for x in parts])
        _, _, inverse, used, edges = _bucketed(np.concatenate([h for _, h, _ in found]), np.concatenate([doc + n for (_, _, doc), n in zip(found, before, strict=False)]), buckets)
        flag = np.zeros(edges[-1], np.uint8)
        for k, f in zip(np.searchsorted(used, flags.column("bucket").to_numpy()).tolist(), flags.column("flags").to_pylist(), strict=True):
            flag[edges[k] : edges[k + 1]] = np.frombuffer(f, np.uint8)
        flag = np.split(flag[inverse], np.cumsum([len(h) for _, h, _ in found])[:-1])
        around, window, covered = [], [], []
        for k, (x, (at, h, doc)) in enumerate(zip(parts, found, strict=True)):
            keep, found[k], parts[k] = flag[k] > 0, None, None  # a part at a time is held in full
            if keep.any():
                near, far, ranges = _of_part(x, at[keep], h[keep], doc[keep], flag[k][keep])
                for rows, to in ((near, around), (far, window)):
                    if rows:
                        to.append(rows | {"doc": (rows["doc"] + before[k]).astype(np.int32)})
                covered.append(ranges + [before[k], 0, 0])
        out: list[tuple[int, str, bytes]] = []
        if around:
            n = np.cumsum([0] + [len(a["rows"]) for a in around])
            x = {c: np.concatenate([a[c] + n[j] if c == "which" else a[c] for j, a in enumerate(around)]) for c in around[0]}
            around.clear()
            b = ((x["h"] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            full, cuts = runs(b[order])
            for k, begin, end in zip(full.tolist(), cuts, cuts[1:], strict=False):
                o = order[begin:end]
                u, which = np.unique(x["which"][o], return_inverse=True)
                out.append((k, "around", _pack(**{c: x[c][o] for c in ("h", "ids", "doc", "pos")}, which=which.astype(np.int32), **{c: x[c][u] for c in ("left", "right", "rows")})))
        if window:
            x = {c: np.concatenate([w[c] for w in window]) for c in window[0]}
            window.clear()
            b = (_mix(x["win"]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            full, cuts = runs(b[order])
            for k, begin, end in zip(full.tolist(), cuts, cuts[1:], strict=False):
                out.append((buckets + k, "window", _pack(**{c: v[order[begin:end]] for c, v in x.items()})))
        ranges = _union(np.concatenate(covered)) if covered else np.empty((0, 3), np.int64)
        if len(ranges):
            out.append((2 * buckets + block, "covered", _pack(ranges=ranges)))
        return pa.table({"bucket": [o[0] for o in out], "kind": [o[1] for o in out], "block": [block] * len(out), "data": [o[2] for o in out]}, schema=schema)

    return run


def _of_part(x: dict[str, np.ndarray], at: np.ndarray, h: np.ndarray, doc: np.ndarray, flag: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray]:
    """Of a part's shared anchors: the surroundings to be sent, the windows to be sent of those in many documents, and the ranges that the part's own earlier documents cover."""
    data, lens, ids = x["data"], x["lens"], x["ids"]
    ends, covered, step = np.cumsum(lens), [], 1 << 16
    kept, which, n = [], [], 0
    for a in range(0, len(at), step):  # of equal surroundings side by side one copy is held
        s = slice(a, a + step)
        rows, left, right = _around(data, at[s], (ends - lens)[doc[s]], ends[doc[s]])
        whole = _hash_rows(rows, left, right)
        _, first, inverse = np.unique(whole ^ h[s] * _C, return_index=True, return_inverse=True)
        kept.append((rows[first], left[first].astype(np.uint8), right[first].astype(np.uint8), whole[first]))
        which.append(inverse + n)
        n += len(first)
    rows, left, right, whole = (np.concatenate(c) for c in zip(*kept, strict=True))
    which = np.concatenate(which)
    own, pos = ids[doc], at - (ends - lens)[doc]
    later = own > _least((h, whole[which]), own)
    covered.append(np.c_[doc, pos - left[which], pos + right[which]][later])
    o = np.flatnonzero(~later & (flag == 1))
    u, at_u = np.unique(which[o], return_inverse=True)
    near = {"h": h[o], "ids": own[o], "doc": doc[o], "pos": pos[o].astype(np.int64), "which": at_u, "left": left[u], "right": right[u], "rows": rows[u][:, _SIDES]} if len(o) else {}
    warm, far = np.flatnonzero(~later & (flag == 2)), {}
    if len(warm):
        spot, step_no = (c.ravel() for c in np.meshgrid(warm, np.arange(STEPS), indexing="ij"))
        of = which[spot]
        fits = (step_no >= GRAM - left[of]) & (step_no + LENGTH <= GRAM + right[of].astype(np.int64))
        spot, of, step_no = spot[fits], of[fits], step_no[fits]
        if len(spot):
            win = np.concatenate([_hash_rows(rows[of[a : a + step, None], step_no[a : a + step, None] + np.arange(LENGTH)]) for a in range(0, len(of), step)])
            wid, wdoc, wstart = own[spot], doc[spot], pos[spot] - GRAM + step_no
            tag = h[spot] + step_no.astype(np.uint64)
            later = wid > _least((win, tag), wid)
            covered.append(np.c_[wdoc, wstart, wstart + LENGTH][later])
            o = np.flatnonzero(~later)
            far = {"win": win[o], "tag": tag[o], "ids": wid[o], "doc": wdoc[o], "start": wstart[o]}
    return near, far, np.concatenate(covered)


def _union(ranges: np.ndarray) -> np.ndarray:
    """Rows (document, begin, end), with those merged that touch or overlap."""
    if not len(ranges):
        return ranges.reshape(0, 3).astype(np.int64)
    ranges = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))].astype(np.int64)
    shift = ranges[:, 0] * (int(ranges[:, 2].max()) + 2)  # documents apart: one running maximum serves all
    begin, reach = ranges[:, 1] + shift, np.maximum.accumulate(ranges[:, 2] + shift)
    new = np.flatnonzero(np.r_[True, begin[1:] > reach[:-1]])
    last = np.r_[new[1:], len(ranges)] - 1
    return np.c_[ranges[new, 0], ranges[new, 1], reach[last] - shift[last]]


def _compare(rows: pa.Table) -> pa.Table:
    """Of a bucket: the ranges that earlier documents cover, by block."""
    kind = rows.column("kind")[0].as_py()
    blocks = rows.column("block").to_pylist()
    parts = [_unpack(x) for x in rows.column("data").to_pylist()]
    if kind == "covered":
        found = [(b, p["ranges"]) for b, p in zip(blocks, parts, strict=True)]
    else:
        base = np.cumsum([0] + [len(p["rows"]) for p in parts[:-1]]) if kind == "around" else None
        x = {k: np.concatenate([p[k] + base[j] if k == "which" else p[k] for j, p in enumerate(parts)]) for k in parts[0]}
        home = np.repeat(np.arange(len(parts)), [len(p["ids"]) for p in parts])
        if kind == "window":
            late = x["ids"] > _least((x["win"], x["tag"]), x["ids"])
            row, begin, end = np.flatnonzero(late), x["start"][late], x["start"][late] + LENGTH
        else:
            row, begin, end = _covered_around(x)
        found = []
        for k in np.unique(home[row]).tolist():
            m = home[row] == k
            found.append((blocks[k], _union(np.c_[x["doc"][row[m]], begin[m], end[m]])))
    return pa.table({"block": pa.array([b for b, _ in found], pa.int64()), "data": pa.array([_pack(ranges=r) for _, r in found], pa.binary())})


def _covered_around(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of surroundings, and the range of each that earlier documents hold."""
    ids, pos, which = x["ids"], x["pos"], x["which"]
    left, right = x["left"].astype(np.int64)[which], x["right"].astype(np.int64)[which]
    whole = _hash_rows(x["rows"], x["left"], x["right"])[which]
    least = _least((x["h"], whole), ids)
    late = np.flatnonzero(ids > least)
    order = np.lexsort((ids, whole, x["h"]))
    h, whole = x["h"][order], whole[order]
    new_group = np.r_[True, h[1:] != h[:-1]]
    new_class = new_group | np.r_[True, whole[1:] != whole[:-1]]
    class_of = np.empty(len(ids), np.int64)
    class_of[order] = np.cumsum(new_class) - 1
    head = order[new_class]  # of each class a row of its earliest document
    group = (np.cumsum(new_group) - 1)[new_class]
    open_ = np.flatnonzero(np.bincount(group)[group] > 1)
    low, high = np.full(len(head), SPAN), np.full(len(head), -1)
    edges = np.flatnonzero(np.r_[True, group[open_][1:] != group[open_][:-1]]) if len(open_) else np.empty(0, int)
    a = 0
    while a < len(edges):  # some thousand surroundings at a time, whole groups each
        b = a + 1
        while b < len(edges) and edges[b] - edges[a] < 4096:
            b += 1
        these = open_[edges[a] : edges[b] if b < len(edges) else len(open_)]
        r = head[these]
        low[these], high[these] = _windows(_whole(x["rows"][which[r]]), left[r], right[r], group[these], ids[r])
        a = b
    rest = np.flatnonzero((ids == least) & (high[class_of] >= 0))
    c = class_of[rest]
    row = np.r_[late, rest]
    begin = np.r_[pos[late] - left[late], pos[rest] - GRAM + low[c]]
    return row, begin, np.r_[pos[late] + right[late], pos[rest] - GRAM + high[c] + LENGTH]


def _whole(sides: np.ndarray) -> np.ndarray:
    """The surroundings in their full width; the bytes of the anchor, equal within a group, stay 0."""
    rows = np.zeros((len(sides), SPAN), np.uint8)
    rows[:, _SIDES] = sides
    return rows


def _windows(rows: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window (SPAN and -1: none) of each row that a row of its group with a smaller id has at the same place."""
    m, width = len(rows), 2 * SIDE + 1
    power = 256 ** np.arange(SYMBOL, dtype=np.int64)
    parts = rows.reshape(m, SPAN // SYMBOL, SYMBOL).astype(np.int64) @ power
    outer = np.r_[np.arange(SIDE), np.arange(2 * SIDE, 3 * SIDE)]
    full = (outer * SYMBOL >= (GRAM - left)[:, None]) & ((outer + 1) * SYMBOL <= (GRAM + right)[:, None])
    lone = (1 << 50) + np.arange(m)[:, None] * width + np.arange(2 * SIDE)  # symbols that equal no other
    sides = np.where(full, parts[:, outer], lone)
    text = np.c_[sides[:, :SIDE], (1 << 42) + group[:, None], sides[:, SIDE:]].ravel()
    text = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = suffix_array(text)
    need = np.tile(np.r_[SIDE + 1, [SIDE] * SIDE, [0] * SIDE], m)
    place = order % width
    linked = common_at_least(text, order, need) & (place[1:] == place[:-1]) & (place[1:] <= SIDE)
    class_ = np.r_[0, np.cumsum(~linked)]
    used = np.flatnonzero((np.r_[linked, False] | np.r_[False, linked]) & (place <= SIDE))
    row, place, class_ = order[used] // width, place[used], class_[used]
    low, high = np.full(m, SPAN), np.full(m, -1)
    for b in range(SIDE + 1):
        mine = np.flatnonzero(place == b)
        for r in range(max(0, SYMBOL * (b - 1) + 1), SYMBOL * b + 1):
            i = mine[(r >= GRAM - left[row[mine]]) & (r + LENGTH <= GRAM + right[row[mine]])]
            if not len(i):
                continue
            rest = [*range(r, SYMBOL * b), *range(SYMBOL * b + LENGTH - SYMBOL, r + LENGTH)] if b else [0] * SYMBOL
            exact = rows[row[i]][:, rest].astype(np.int64) @ power if b else np.zeros(len(i), np.int64)
            hit = row[i][ids[row[i]] > _least((exact, class_[i]), ids[row[i]])]
            low[hit], high[hit] = np.minimum(low[hit], r), np.maximum(high[hit], r)
    return low, high


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finish(with_text: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "spans"] * with_text

    def run(blocks: pa.Table, found: pa.Table) -> pa.Table:
        out, before = [], 0
        got = [_unpack(f)["ranges"] for f in found.column("data").to_pylist()]
        ranges = _union(np.concatenate(got)) if got else np.empty((0, 3), np.int64)
        for blob in blocks.column("data")[0].as_py() if blocks.num_rows else []:
            x = _unpack(blob)
            data, ends = x["data"].tobytes(), np.cumsum(x["lens"]).tolist()
            by = np.searchsorted(ranges[:, 0], before + np.arange(len(ends) + 1)).tolist()
            spans, before = ranges[by[0] : by[-1], 1:].tolist(), before + len(ends)
            for d, (i, null, n, end) in enumerate(zip(x["ids"].tolist(), x["null"].tolist(), x["lens"].tolist(), ends, strict=True)):
                own, begin, pieces, at = spans[by[d] - by[0] : by[d + 1] - by[0]], end - n, [], 0
                for a, b in own:
                    pieces.append(data[begin + at : begin + a])
                    at = b
                kept = b"".join([*pieces, data[begin + at : end]])
                row = (None if null else i, n, n - len(kept), len(own), hashlib.sha256(kept).hexdigest())
                out.append(row + ((kept, [{"begin": a, "end": b} for a, b in own]) if with_text else ()))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct({"begin": pa.int64(), "end": pa.int64()}))]
        return pa.table({name: pa.array([r[k] for r in out], types[k]) for k, name in enumerate(names)})

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, hot: int = 1000, with_text: bool = True) -> DataFrame:
    """Cut out of each document all bytes of 50-byte strings that also start in a document with a smaller id.

    Returns one row per input row: doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256, and if with_text kept (binary) and spans
    (begin, end). A null text is empty. A null id counts as larger than all ids.
    Rows with equal ids do not remove each other's bytes. Texts under 50 bytes
    stay whole. Other columns are ignored. An empty table gives an empty one.
    """
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    buckets = buckets_for(docs, BUCKET_BYTES, 256)
    blocks = cut(two.mapInArrow(_blocks, "block long, data array<binary>"), "blocks")
    by_range = blocks.mapInArrow(_hashes(buckets), "bucket long, block long, low binary, docs binary")
    flags = by_range.groupBy("bucket").applyInArrow(_flags(hot), "block long, bucket long, flags binary")
    sent = blocks.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(_send(buckets), "bucket long, kind string, block long, data binary")
    found = sent.groupBy("bucket").applyInArrow(_compare, "block long, data binary")
    schema = _RESULT + (", kept binary, spans array<struct<begin: long, end: long>>" if with_text else "")
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_finish(with_text), schema)
