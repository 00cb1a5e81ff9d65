"""Mixing sources to target weights: raking to marginals, then calibrated sampling. DataFrame operations only."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm._shared import Scratch

DIMENSIONS = ("source", "lang", "topic")
#: The topic of a text is the first whose pattern it holds, else the default.
TOPICS = (
    ("license", r"(?i)licensed under|all rights reserved|permission is hereby granted|warranty"),
    ("contact", r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z]|[(][0-9]{3}[)] [0-9]{3}-[0-9]{4}"),
    ("table", r" [|] "),
)
DEFAULT_TOPIC = "prose"
UNKNOWN = "unknown"
#: How far from its target, in shares of it, a marginal may stay without a warning.
TOLERANCE = 0.01


def topic_of(text: Column) -> Column:
    out = F.lit(DEFAULT_TOPIC)
    for name, pattern in reversed(TOPICS):
        out = F.when(F.coalesce(text, F.lit("")).rlike(pattern), name).otherwise(out)
    return out


def words_of(text: Column) -> Column:
    """Number of words, runs of characters other than ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def describe(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", row_col: str | None = None
) -> DataFrame:
    """``doc_id, source, lang, topic, tokens`` with null source and language as 'unknown'; also ``row``, if ``row_col`` names a number of the rows."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit(UNKNOWN)).alias("source"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
        topic_of(F.col(text_col)).alias("topic"),
        words_of(F.col(text_col)).alias("tokens"),
        *([] if row_col is None else [F.col(row_col).alias("row")]),
    )


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares in proportion to a power of the observed tokens, which lifts small values: ``value, share``."""
    seen = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0")
    seen = seen.select("value", F.pow("t", F.lit(float(power))).alias("raised"))
    total = seen.agg(F.sum("raised")).first()[0] or 1.0
    return seen.select("value", (F.col("raised") / F.lit(total)).alias("share"))


def completed(cells: DataFrame, dimension: str, target: DataFrame) -> DataFrame:
    """A target with every value that occurs: those it doesn't state keep their observed share, the stated ones take the rest."""
    seen = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0")
    total = seen.agg(F.sum("t")).first()[0] or 1
    own = seen.join(target.select("value"), "value", "left_anti").select("value", (F.col("t") / F.lit(float(total))).alias("share"))
    rest = 1.0 - (own.agg(F.sum("share")).first()[0] or 0.0)
    return target.select("value", (F.col("share") * F.lit(rest)).alias("share")).union(own)


def rake(scratch: Scratch, cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 12, name: str = "rake") -> DataFrame:
    """Iterative proportional fitting of the cells' tokens to the targets of each dimension.

    ``cells`` has one row per combination with ``tokens``; each target has ``value, share``. A round
    scales the weights of each dimension in turn to its shares of all tokens. A value without a target
    weighs nothing. Warns if some marginal is still further than TOLERANCE of it from its target. Returns the cells with ``weight``, in tokens. There are as many cells as
    combinations that occur, however many documents; a round's sums are aggregates over them, only the
    grand total reaches the driver, and lineage is cut after each round.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    goals = {
        dim: scratch.table(target.select(F.col("value").alias(dim), (F.col("share") * F.lit(float(total))).alias("goal")), f"{name}-goal-{dim}")
        for dim, target in targets.items()
    }
    now = cells.where("tokens > 0").withColumn("weight", F.col("tokens").cast("double"))
    for dim, goal in goals.items():
        now = now.join(goal.withColumnRenamed("goal", f"goal_{dim}"), dim, "left")
    now = scratch.table(now, f"{name}-0")
    for k in range(1, rounds + 1):
        step = now
        for dim in goals:
            sums = step.groupBy(dim).agg(F.sum("weight").alias("own"), F.first(f"goal_{dim}").alias("goal"))
            factor = sums.select(dim, F.coalesce(F.col("goal") / F.nullif("own", F.lit(0.0)), F.lit(0.0)).alias("factor"))
            step = step.join(factor, dim).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
        now = scratch.table(step, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
    far = 0.0
    for dim in goals:
        sums = now.groupBy(dim).agg(F.sum("weight").alias("own"), F.first(f"goal_{dim}").alias("goal"))
        far = max(far, sums.agg(F.max(F.abs(F.col("own") / F.col("goal") - 1))).first()[0] or 0.0)
    if far > TOLERANCE:
        warnings.warn(f"after {rounds} rounds a marginal is {far:.1%} away from its target", stacklevel=2)
    return now.drop(*(f"goal_{dim}" for dim in goals))


def calibrate(raked: DataFrame, budget: float, rounds: int = 12) -> DataFrame:
    """Adds ``probability = min(1, scale * weight / tokens)``, with expected tokens ``budget`` times all tokens.

    Each round raises the scale by what the cells that are taken whole can't give; only these sums
    reach the driver.
    """
    ratio, scale = F.col("weight") / F.col("tokens"), float(budget)
    for _ in range(rounds):
        whole = ratio * F.lit(scale) >= 1
        s = raked.agg(
            F.sum("tokens").alias("all"), F.sum(F.when(whole, F.col("tokens"))).alias("whole"), F.sum(F.when(~whole, F.col("weight"))).alias("rest")
        ).first()
        if not s["rest"]:
            break
        before, scale = scale, (budget * s["all"] - (s["whole"] or 0)) / s["rest"]
        if abs(scale - before) <= 1e-12 * before:
            break
    return raked.withColumn("probability", F.least(F.lit(1.0), ratio * F.lit(scale)))


def chance(id_col: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on id and seed only: the first 52 bits of a SHA-256 digest."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 13), 16, 10).cast("double") / float(2**52)


def mix(
    scratch: Scratch, described: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = 0.5,
    powers: dict[str, float] | None = None, rounds: int = 12,
) -> DataFrame:
    """Cells with the probability at which their documents are sampled: ``source, lang, topic, tokens, weight, probability``.

    Targets come as tables ``value, share`` per dimension; a dimension without one is tempered by its
    power (1 keeps the observed shares). Values that a given target doesn't state, 'unknown' included,
    keep their observed share of all tokens; the stated shares are scaled to the rest.
    """
    cells = described.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    cells = scratch.table(cells, "cells")
    powers = {"source": 0.5, "lang": 0.7, "topic": 1.0} | (powers or {})
    given = targets or {}
    goals = {dim: completed(cells, dim, given[dim]) if dim in given else tempered(cells, dim, powers[dim]) for dim in DIMENSIONS}
    raked = rake(scratch, cells, goals, rounds)
    return scratch.table(calibrate(raked, budget), "mixed")


def sample(described: DataFrame, mixed: DataFrame, seed: str = "mix") -> DataFrame:
    """Each document with its cell's weight and probability and whether it is in the sample.

    ``doc_id, source, lang, topic, tokens, cell_weight, probability, sampled``. A document of a cell
    without tokens (no text, or only such documents) has probability 0 and isn't sampled; ``row`` is
    returned as well where ``described`` has it; null source
    and language count as 'unknown'; a null id draws the same number as any other null id; repeated
    rows of one id are all in or all out. An empty table gives no rows.
    """
    cells = mixed.select(*DIMENSIONS, F.col("weight").alias("cell_weight"), "probability")
    out = described.join(cells, list(DIMENSIONS), "left")
    p = F.coalesce("probability", F.lit(0.0))
    return out.select(
        "doc_id", *DIMENSIONS, "tokens", F.coalesce("cell_weight", F.lit(0.0)).alias("cell_weight"), p.alias("probability"),
        ((F.col("tokens") > 0) & (chance(F.col("doc_id"), seed) < p)).alias("sampled"),
        *(["row"] if "row" in described.columns else []),
    )
