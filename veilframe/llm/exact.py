"""Exact deduplication by a tree-merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def digest_rows(docs: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """``id, row, points, digest, check``: the digest decides, the check (length and a second hash) verifies."""
    row = F.lit(0) if row_col is None else F.col(row_col)
    text = docs.select(F.col(id_col).cast("long").alias("id"), row.cast("long").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = text.select("id", "row", F.length("text").cast("long").alias("points"), normalised(F.col("text")).alias("body"))
    return rows.select(
        "id",
        "row",
        "points",
        F.unhex(F.sha2("body", 256)).alias("digest"),
        F.struct(F.octet_length("body").alias("bytes"), F.xxhash64("body").alias("hash")).alias("check"),
    )


def merge_runs(rows: DataFrame, radix: int = 8, rounds: int = 3) -> DataFrame:
    """One row per digest: ``digest, check, best (points, id, row), n``.

    Every input partition is a run, numbered in base ``radix``. In round r a run hands each entry to
    the run whose r-th digit is that of the entry's digest, so after all rounds a digest lives in one
    run. The runs are what is exchanged: a run's pieces meet in one partition, are sorted by digest there
    and merged into the best identifier of each. A digest that fills a third of the table comes from all
    runs and is spread over ``radix ** (rounds - 1)`` of them by the first round, after which it is one row in
    each. Entries merge only if length and second hash agree as well.
    """
    slots = radix**rounds
    best = F.struct((-F.col("points")).alias("neg_points"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("row").alias("row"))
    home = F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), F.lit(slots))
    runs = rows.select(
        "digest", "check", best.alias("best"), F.lit(1).cast("long").alias("n"),
        F.pmod(F.spark_partition_id().cast("long"), F.lit(slots)).alias("slot"), home.alias("home"),
    )
    for r in range(rounds):
        unit = radix**r
        digit = lambda c: F.floor(F.col(c) / unit) % radix  # noqa: B023, E731
        runs = runs.withColumn("slot", (F.col("slot") + (digit("home") - digit("slot")) * unit).cast("long"))
        runs = runs.repartition("slot").sortWithinPartitions("slot", "digest")
        runs = runs.groupBy("slot", "digest", "check", "home").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    return runs.select("digest", "check", "best", "n")


def dedup_exact(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radix: int = 8, rounds: int = 3, row_col: str | None = None
) -> DataFrame:
    """Which of the texts that are equal without white space stays.

    Of equal texts the one with the most code points stays, then the one with the smallest id.
    Returns one row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty, and all empty texts are one group. A null id comes after every other
    id; a row without id is kept only if its whole group has none. Rows that repeat an id with a text
    of the same length are the same document and share its fate,
    unless ``row_col`` names a number that is each row's own: then one row of each group stays, of equal
    ones the smallest number, and the number is returned as well, as ``row``. An empty table gives no rows; other columns are ignored.
    """
    rows = digest_rows(docs, id_col, text_col, row_col)
    merged = merge_runs(rows, radix, rounds).select("digest", "check", "best", "n")
    joined = rows.join(merged, ["digest", "check"])
    return joined.select(
        F.col("id").alias("doc_id"),
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("points") == -F.col("best.neg_points")) & (F.col("row") == F.col("best.row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *([] if row_col is None else ["row"]),
    )
