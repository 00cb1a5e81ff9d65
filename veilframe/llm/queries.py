"""The registered queries over the test tables and the SQL that must give the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import bpe, chat, counts, embed, exact, lines, lm, minhash, mixing, quality
from veilframe.llm._shared import Scratch

BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
#: Production parameters of the mix: languages in fixed shares, sources tempered, half of all tokens.
LANGUAGES = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
SOURCE_POWER, BUDGET, ROUNDS = 0.5, 0.5, 12
#: Below this probability of good a document is rejected.
QUALITY = 0.3
FIRST_CONVERSATION = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language_targets(spark: SparkSession) -> dict[str, DataFrame]:
    rows = spark.sql("SELECT stack(4, " + ", ".join(f"'{k}', {v}D" for k, v in LANGUAGES.items()) + ") AS (value, share)")
    return {"lang": rows}


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op1")
    described = scratch.table(mixing.describe(table(spark, sf_dir, "documents")), "described")
    mixed = mixing.mix(scratch, described, language_targets(spark), BUDGET, {"source": SOURCE_POWER}, ROUNDS)
    out = mixing.sample(described, mixed)
    digits = {"cell_weight": "round(cell_weight, 2)", "probability": "round(probability, 6)"}
    return out.selectExpr(*(f"{digits.get(c, c)} AS {c}" for c in out.columns))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(Scratch(spark, "op2", tidy=True), table(spark, sf_dir, "documents"))
    return done.selectExpr("doc_id", "n_lines", "n_removed", "sha2(text, 256) AS text_sha256")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup_exact(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.dedup_embeddings(Scratch(spark, "op5"), table(spark, sf_dir, "embeddings"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(Scratch(spark, "op6"), table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), class_col="lang")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), threshold=QUALITY)


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.dedup_minhash(Scratch(spark, "op8"), table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    first = f"SELECT stack(2, -1L, 0L, 'user', '{FIRST_CONVERSATION}', -1L, 1L, 'assistant', '{FIRST_CONVERSATION}') AS (conv_id, turn, role, text)"
    formatted = chat.format_chats(Scratch(spark, "op9"), turns.union(spark.sql(first)), public_tokenizers.path(PIECES))
    return chat.read_back(formatted, in_order=True)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def mixing_sql() -> str:
    """The same fitting in SQL, each step over the table of the one before."""
    dims = mixing.DIMENSIONS
    topic = " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in mixing.TOPICS)
    keys = ", ".join(dims)
    steps = [
        f"""described AS MATERIALIZED (SELECT doc_id, coalesce(source, '{mixing.UNKNOWN}') AS source, coalesce(lang, '{mixing.UNKNOWN}') AS lang,
        CASE {topic} ELSE '{mixing.DEFAULT_TOPIC}' END AS topic,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM documents)""",
        f"cells AS MATERIALIZED (SELECT {keys}, CAST(sum(tokens) AS BIGINT) AS tokens FROM described GROUP BY ALL)",
        "total AS MATERIALIZED (SELECT sum(tokens)::DOUBLE AS t FROM cells)",
        f"goal_source AS MATERIALIZED (SELECT source, pow(t, {SOURCE_POWER}) / sum(pow(t, {SOURCE_POWER})) OVER () * (SELECT t FROM total) AS goal FROM (SELECT source, sum(tokens)::DOUBLE AS t FROM cells GROUP BY ALL) WHERE t > 0)",
        "goal_lang AS MATERIALIZED (SELECT lang, share * (SELECT t FROM total) AS goal FROM (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in LANGUAGES.items()) + ") AS x(lang, share))",
        "goal_topic AS MATERIALIZED (SELECT topic, sum(tokens)::DOUBLE AS goal FROM cells GROUP BY ALL HAVING sum(tokens) > 0)",
        f"r0 AS MATERIALIZED (SELECT {keys}, tokens, tokens::DOUBLE AS weight FROM cells WHERE tokens > 0)",
    ]
    k = 0
    for _ in range(ROUNDS):
        for dim in dims:
            steps.append(f"r{k + 1} AS MATERIALIZED (SELECT r.source, r.lang, r.topic, r.tokens, r.weight * coalesce(g.goal / nullif(sum(r.weight) OVER (PARTITION BY r.{dim}), 0), 0) AS weight FROM r{k} r LEFT JOIN goal_{dim} g ON r.{dim} = g.{dim})")
            k += 1
    steps.append(f"s0 AS MATERIALIZED (SELECT {BUDGET}::DOUBLE AS scale)")
    for j in range(ROUNDS):
        steps.append(f"s{j + 1} AS MATERIALIZED (SELECT coalesce(({BUDGET} * sum(tokens) - coalesce(sum(tokens) FILTER (weight / tokens * scale >= 1), 0)) / nullif(sum(weight) FILTER (weight / tokens * scale < 1), 0), max(scale)) AS scale FROM r{k}, s{j})")
    steps.append(f"mixed AS MATERIALIZED (SELECT {keys}, weight, least(1.0, weight / tokens * scale) AS probability FROM r{k}, s{ROUNDS})")
    draw = f"CAST('0x' || substr(sha256('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)::DOUBLE / {2**52}"
    return f"""WITH {', '.join(steps)}
    SELECT doc_id, {keys}, d.tokens, round(coalesce(weight, 0), 2) AS cell_weight, round(coalesce(probability, 0), 6) AS probability,
    d.tokens > 0 AND {draw} < coalesce(probability, 0) AS sampled FROM described d LEFT JOIN (SELECT {keys}, weight, probability FROM mixed) m USING ({keys})"""


EXACT_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
first_value(doc_id) OVER w = doc_id AS kept, text_sha256 FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mixing, op2_line_dedup, op3_exact_dedup, op4_byte_bpe, op5_embedding_dedup,
        op6_lm_scoring, op7_quality, op8_minhash_dedup, op9_chat_format, op10_token_counts,
    )
}


def oracle_sql() -> dict[str, str]:
    """Operators that SQL can't express are tested against brute force instead."""
    return {"op1_source_mixing": mixing_sql(), "op3_exact_dedup": EXACT_SQL}
