"""Packing by concatenating and cutting: documents' token streams joined, cut every `size` tokens.

Pass one tokenises each document once and writes its ids with its place in its
partition. The partitions' token totals, summed up in partition order, give every
partition its global offset. Pass two cuts each document at the multiples of the
size that it crosses. Sequences are full but for the very last one.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, once_a_worker, tidy

CACHE = 150_000
MOST_PARTS = 1 << 20  # partitions whose offsets, 12 bytes each, are broadcast
#: Separators that Python takes for white space and the tokenizer's \s does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: The tokenizer's pieces of a lower-cased text without characters over U+00FF.
PIECES_OF = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾\s]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable Latin-1, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def pack_ids(ids: list[int]) -> bytes:
    """As unsigned little-endian 32 bit numbers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class PieceIds(dict):
    """Piece of a text -> its ids as bytes, by the tokenizer's model.

    Texts up to U+00FF, which normal form leaves as they are, are cut into the
    tokenizer's pieces here. Of other texts each word is, for the tokenizer never
    joins characters across white space; words that have other characters, or a
    special token, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        plain = "A Thin's 12x,é!"  # does the short way hold for this vocabulary?
        self.short = self._short(plain) == self._whole(plain)

    def _whole(self, text: str) -> bytes:
        return pack_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, piece: str) -> bytes:
        letters = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
        ids = pack_ids([t.id for t in self.model.tokenize(letters)])
        if len(self) >= CACHE:
            self.clear()
        if len(piece) < 40:
            self[piece] = ids
        return ids

    def _short(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, PIECES_OF.findall(text.lower())))

    def _is_short(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return self.short

    def text(self, text: str) -> bytes:
        if "<|" in text or ODD_SPACE.search(text):
            return self._whole(text)
        if self._is_short(text):
            return self._short(text)
        return b"".join([self._short(w) if self._is_short(w) else self._whole(w) for w in text.split()])


def _tokenise(path: str, end_id: int):
    end = pack_ids([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, at = once_a_worker(f"pieces {path}", lambda: PieceIds(path)), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                some = batch.slice(a, 500)
                ids = [words.text(t or "") + end for t in some.column(1).to_pylist()]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                starts = at + np.r_[0, np.cumsum(sizes)[:-1]]
                at += int(sizes.sum())
                blobs = [np.frombuffer(x, "<u4") for x in ids]  # two bytes an id where that is enough
                blobs = [x.astype("<u2").tobytes() if x.max() < 65536 else x.tobytes() for x in blobs]
                yield pa.record_batch([some.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(starts), pa.array(sizes), pa.array(blobs, pa.binary())], names=["doc_id", "part", "at", "tokens", "ids"])
        tidy()

    return run


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(size: int, with_ids: bool):
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, 1000) for whole in batches for a in range(0, whole.num_rows, 1000)):
            out, pieces = [], []
            for doc, at, n, blob in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "tokens", "ids")), strict=True):
                raw = memoryview(np.frombuffer(blob, "<u2").astype("<u4").tobytes() if len(blob) == 2 * n else blob)
                begin = 0
                while begin < n:
                    offset = (at + begin) % size
                    length = min(size - offset, n - begin)
                    piece = raw[4 * begin : 4 * (begin + length)]
                    out.append((doc, begin, length, zlib.crc32(piece), n, (at + begin) // size, offset))
                    if with_ids:
                        pieces.append(np.frombuffer(piece, "<u4").tolist())
                    begin += length
            columns = [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 7)]
            more = [pa.array(pieces, pa.list_(pa.int64()))] if with_ids else []
            yield pa.record_batch(columns + more, names=names + ["ids"] * with_ids)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 4096, end_id: int = 2, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of documents in sequences of size tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked.

    Each document's ids end with end_id; a null or empty text is that id alone.
    Sequences are gapless; only the last may be shorter, to be padded to size
    unless its length is a power of two. Repeated rows and null ids are packed
    like others. An empty table gives no piece. Other columns are ignored.
    """
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tokens = cut(two.mapInArrow(_tokenise(tokenizer or default_tokenizer(), end_id), "doc_id long, part int, at long, tokens long, ids binary"), "tokens")
    totals = cut(tokens.groupBy("part").agg(F.sum("tokens").alias("total")), "totals")  # one row an input partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    few = totals.count() <= MOST_PARTS  # else Spark chooses the join
    placed = tokens.join(F.broadcast(offsets) if few else offsets, "part").select("doc_id", (F.col("at") + F.col("base")).alias("at"), "tokens", "ids")
    return placed.mapInArrow(_cut(size, with_ids), PIECES + (", ids array<long>" if with_ids else ""))


def padded_length(tokens: int, size: int = 4096) -> int:
    """The length to which a sequence of so many tokens is padded: size, or its own if that is a power of two."""
    return tokens if tokens and tokens & (tokens - 1) == 0 else size
