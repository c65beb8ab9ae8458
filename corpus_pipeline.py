"""A training-data pipeline over documents: rules, near-duplicates, privacy, mixture, packing.

Each stage gets all rows that its predecessor kept; all but the last return the
columns of documents. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odflow.llm.common import cut, private_key, table
from odflow.llm.mixing import mix
from odflow.llm.near_copies import keep_one
from odflow.llm.packing import pack
from odflow.llm.privacy import pseudonymise
from odflow.llm.quality_rules import quality_rules
from odflow.llm.queries import TARGETS


def _with_text(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The given columns, with another text and, where there is one, its length."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return df.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in columns])


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines shared by too many documents go, then documents that the rules reject."""
    judged = cut(quality_rules(docs).select(*[f"`{c}`" for c in docs.columns], F.col("_rules.kept").alias("_kept"), "_cleaned"), "judged")
    return _with_text(judged.where("_kept"), docs.columns, "_cleaned")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose five-word shingles have a similarity of 0.8 or more."""
    return keep_one(docs, words_each=5, least=0.8)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private values become pseudonyms."""
    return _with_text(pseudonymise(docs, key=private_key(spark)), docs.columns, "text")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that token shares meet the targets."""
    return mix(docs, TARGETS).where("_mix.sampled").select(*[f"`{c}`" for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token streams in sequences of 4096."""
    return pack(docs, with_ids=False)


STAGES = [("quality_rules", rules), ("simhash_near_dedup", near_dedup), ("private_pseudonyms", privacy), ("source_mixing", mixture), ("packing", packing)]

#: SQL has no XXH64 fingerprints and no tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
