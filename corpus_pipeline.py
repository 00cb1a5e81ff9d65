"""A corpus pipeline: quality classifier, exact dedup, MinHash near-dedup, source mixing, byte-level BPE.

Each stage takes ``(spark, docs, sf_dir)``; what it returns is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import bpe, exact, minhash, mixing, quality
from veilframe.llm._shared import Scratch
from veilframe.llm.queries import BYTE_RANKS, QUALITY, language_targets, table

#: Share of the tokens that the mix keeps.
MIX_BUDGET = 0.8

#: SQL can't express the classifier, the signatures or the encoding; tests compare with brute force.
ORACLE_SQL = None


#: The number that is each row's own within a stage; ids may be null or repeat.
ROW = "__row"


def numbered(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """The stage's input with ROW, written once so that all who read it see the same numbers."""
    return scratch.table(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered", "zstd")


def without(scratch: Scratch, rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The numbered rows that aren't among ``gone``, a table of numbers, without their number; its size on disk decides how Spark joins it."""
    gone = scratch.table(gone.toDF(ROW), "gone")
    return rows.join(gone, ROW, "left_anti").drop(ROW)


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "quality")
    rows = numbered(scratch, docs)
    scored = quality.classify(rows, quality.fit(rows), QUALITY, ROW)
    return without(scratch, rows, scored.where("NOT kept").select("doc_id"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "exact")
    rows = numbered(scratch, docs)
    return without(scratch, rows, exact.dedup_exact(rows, row_col=ROW).where("NOT kept").select("row"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are the nodes; of each component the row with the smallest id stays, one without id only if none has one."""
    scratch = Scratch(spark, "near")
    rows = numbered(scratch, docs)
    near = minhash.dedup_minhash(scratch, rows, id_col=ROW).select(F.col("doc_id").alias(ROW), F.col("component_id").alias("__group"))
    near = scratch.table(near.join(rows.select(ROW, F.col("doc_id").cast("long").alias("__id")), ROW), "rows-of-groups")
    order = F.struct(F.col("__id").isNull().alias("no_id"), "__id", ROW)
    kept = scratch.table(near.groupBy("__group").agg(F.min(order).alias("__kept"), F.count(F.lit(1)).alias("__n")).where("__n > 1"), "kept-of-groups")
    return without(scratch, rows, near.join(kept, "__group").where(F.col(ROW) != F.col(f"__kept.{ROW}")).select(ROW))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "mix")
    rows = numbered(scratch, docs)
    described = scratch.table(mixing.describe(rows, row_col=ROW), "described")
    mixed = mixing.mix(scratch, described, language_targets(spark), MIX_BUDGET)
    return without(scratch, rows, mixing.sample(described, mixed).where("NOT sampled").select("row"))


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("byte-level BPE", encode_bytes),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, f"stage-{k}")
            if k:
                scratch.drop(f"stage-{k - 1}")
    return docs
