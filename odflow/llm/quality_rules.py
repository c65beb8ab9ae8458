"""Quality rules on words and lines, and removal of lines that many documents of a host share.

All of it is DataFrame expressions. A document counts once however often its text is
repeated: exact copies are no evidence against its lines, or every document with more
copies than the limit would lose all its lines in all its copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOOM_BITS, SPACE, SPACE_RE, cut, let, refuse, with_bloom

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_RE), lambda w: w != "")


def _covered(hashes: Column) -> Column:
    """How many words lie in windows whose hash occurs twice or more; hashes[i] is the window that starts at word i."""

    def of_pairs(pairs: Column) -> Column:
        here = lambda j: F.get(pairs, j)["h"]
        twice = F.transform(pairs, lambda p, j: F.when(p["h"].eqNullSafe(here(j - 1)) | p["h"].eqNullSafe(here(j + 1)), p["i"]))
        starts = F.sort_array(F.filter(twice, lambda i: i.isNotNull()))
        return let(starts, lambda s: F.aggregate(F.transform(s, lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(s, j + 1) - i, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x))

    return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_pairs)


def repeat_words(words: Column) -> Column:
    """Words in windows of WINDOW words that the text holds twice or more, the first included."""
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h)))
    return F.when(F.size(words) > WINDOW, some).otherwise(F.lit(0).cast("long"))


def text_rules(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text without null."""
    has_word = lambda line: line.rlike("[^\\x20\\x09-\\x0D]")
    duplicates = let(F.filter(F.split(text, "\n"), has_word), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            duplicates.alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )


def line_hash(line: Column) -> Column:
    """Of the line in lower case, white space runs as one space, none at the ends."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), SPACE_RE, " ")))


def _lines(text: Column) -> Column:
    """(h, words) of each line that has a word."""
    each = F.transform(F.split(text, "\n"), lambda x: F.struct(line_hash(x).alias("h"), F.size(words_of(x)).alias("words")))
    return F.filter(each, lambda x: x["words"] > 0)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", *, max_docs: int = 10, min_kept: float = 0.3, bloom_bits: int = BLOOM_BITS) -> DataFrame:
    """The rows of docs with two more columns, _rules (struct) and _cleaned (text without the removed lines).

    _rules has n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_removed_lines, kept_words and kept. A line is removed if more than
    max_docs distinct documents of its host have it; documents of equal text are one.
    A document is kept if the base rules pass and, where lines went, at least the
    share min_kept of its words is left.
    Null texts count as empty, a null host is the host "". Repeated rows get the
    same verdict, an empty table gives an empty one. The columns of docs stay as
    they are; of the names _rules and _cleaned there must be none (ValueError).

    Only texts that lose a line are shuffled: a Bloom filter of bloom_bits bits, 8 MB,
    tells the others apart, whose verdict is their own. When it fills up, more texts
    are shuffled; results don't change.
    """
    refuse(docs, "_rules", "_cleaned")
    text, host = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    key = [F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"), host.alias("host")]
    lines = docs.select(*key, F.explode(F.array_distinct(F.transform(_lines(text), lambda x: x["h"]))).alias("h")).distinct()
    frequent = cut(lines.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > max_docs).select("host", "h"), "frequent")
    removed = cut(lines.join(frequent, ["host", "h"], "left_semi").groupBy("k1", "k2", "host").agg(F.collect_set("h").alias("_frequent")), "removed")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    marked, maybe = with_bloom(docs.select(row, *key), removed, bloom_bits)
    touched = marked.where(maybe).select("_row", "k1", "k2", "host").join(removed, ["k1", "k2", "host"], "left").select("_row", "_frequent")
    alone = marked.where(~maybe).select("_row", F.lit(None).cast("array<long>").alias("_frequent"))
    return _judged(alone, text_col, min_kept).unionByName(_judged(touched, text_col, min_kept))


def _judged(rows: DataFrame, text_col: str, min_kept: float) -> DataFrame:
    """Rules, verdict and cleaned text of rows (_row, _frequent: the hashes of the lines to remove, or null)."""
    own = F.col("_row")[text_col].cast("string")
    text = F.coalesce(own, F.lit(""))
    gone = lambda h: F.coalesce(F.array_contains("_frequent", h), F.lit(False))
    rows = rows.select("*", text_rules(text).alias("_base"), F.when(F.col("_frequent").isNotNull(), _lines(text)).alias("_lines"))
    left = F.aggregate(F.filter("_lines", lambda x: ~gone(x["h"])), F.lit(0).cast("long"), lambda a, x: a + x["words"])
    rows = rows.withColumn("_left", F.when(F.col("_frequent").isNull(), F.col("_base.n_words")).otherwise(left))
    rows = rows.withColumn("_gone", F.when(F.col("_frequent").isNull(), F.lit(0)).otherwise(F.size(F.filter("_lines", lambda x: gone(x["h"])))).cast("long"))
    base_failed = (F.col("_base.n_words") < MIN_WORDS) | (100 * F.col("_base.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_base.n_words"))
    depleted = (F.col("_gone") > 0) & (F.col("_left") < min_kept * F.col("_base.n_words"))
    rules = F.struct(*[F.col(f"_base.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base_failed.alias("base_failed"), F.col("_gone").alias("n_removed_lines"), F.col("_left").alias("kept_words"), (~base_failed & ~depleted).alias("kept"))
    cleaned = F.when(F.col("_gone") == 0, own).otherwise(F.array_join(F.filter(F.split(own, "\n"), lambda x: (F.length(F.translate(x, SPACE, "")) == 0) | ~gone(line_hash(x))), "\n"))
    return rows.select("_row", rules.alias("_rules"), cleaned.alias("_cleaned")).select("_row.*", "_rules", "_cleaned")
