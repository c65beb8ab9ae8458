"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import secrets
import sys
import tempfile
import types
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
#: The same as a Java regular expression.
SPACE_RE = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="odflow-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str, at_most: int | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends here, lost executors lose nothing. The table goes as the session ends.

    at_most: of files, and so of tasks in df's last stage. A small table that many
    partitions of a shuffle write costs a file for each of them, and Hadoop starts two
    processes (chmod) for each file that it makes on a local disk without its native library.
    """
    spark = df.sparkSession
    df = df.coalesce(at_most) if at_most else df
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def until_exit(spark: SparkSession, path: str) -> None:
    """path, which exists, is deleted when the driver's JVM ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def refuse(df: DataFrame, *added: str) -> None:
    """ValueError if df has a column of a name that an operator adds; names differ by more than case."""
    clash = {c.lower() for c in df.columns} & {c.lower() for c in added}
    if clash:
        raise ValueError(f"the table has columns of names that are added: {sorted(clash)}")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's argument is never inlined by the optimizer."""
    return F.transform(F.array(value), body)[0]


def input_bytes(df: DataFrame) -> int:
    """Bytes of what df is made from, for a choice of partition counts; never for a choice of rows.

    The files' size where Spark knows it, else the length of df's texts, counted.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    if known < 1 << 60:
        return known
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    return int(df.agg(F.sum(sum(texts, F.lit(8).cast("long")))).first()[0] or 0)


def buckets_for(df: DataFrame, bytes_each: int, least: int = 32) -> int:
    """How many buckets of about bytes_each the input makes."""
    return max(least, -(-input_bytes(df) // bytes_each))


def runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array, and the edges of their runs."""
    begin = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.empty(0, np.int64)
    return sorted_[begin], np.r_[begin, len(sorted_)].astype(np.int64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BLOOM_BITS = 1 << 26


def with_bloom(rows: DataFrame, keys: DataFrame, bits: int = BLOOM_BITS) -> tuple[DataFrame, Column]:
    """rows (k1: a hash, ...) with a Bloom filter of the keys' k1 joined, and whether a row's key may be among them.

    The filter has one bit a key in bitmaps of 32,768 bits: 8 MB at most by default,
    however many keys there are, so it is always broadcast. When it fills up, more rows
    may be; none of the keys' is ever said not to be.
    """
    place = F.pmod("k1", F.lit(bits))
    pages = keys.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    joined = rows.withColumn("page", F.bitmap_bucket_number(place)).join(F.broadcast(pages), "page", "left")
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substr("bitmap", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return joined, F.coalesce(F.call_function("shiftright", byte, F.pmod(bit, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def private_key(spark: SparkSession) -> str:
    """The key of pseudonyms: spark.odflow.private.key, else one that is drawn for the session and never written down."""
    if not spark.conf.get("spark.odflow.private.key", None):
        spark.conf.set("spark.odflow.private.key", secrets.token_hex(32))
    return spark.conf.get("spark.odflow.private.key")


def once_a_worker(name: str, make: Callable):
    """make()'s result, kept for all tasks that the Python worker runs until one asks for another; functions that travel by value have no globals that last."""
    kept = sys.modules.setdefault("_odflow_worker", types.ModuleType("_odflow_worker")).__dict__
    if name not in kept:
        kept.clear()  # a worker outlives its stage: what that one kept is not needed beside this
        kept[name] = make()
    return kept[name]


def tidy() -> None:
    """Give memory that a task no longer needs back to the system, for workers outlive tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
