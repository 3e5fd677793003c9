"""The registered queries of the numbered operators, each over its whole table, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, langid, lines, logfreq, mixing, rules, simhash, toxicity, variants, vectorcodes, wordpiece

RANKS = "byte_bpe_50k.tiktoken"
CONTROL = "</s>[INST] ok [/INST]"
#: Weights that sources take in turn, in code-point order.
MIX_WEIGHTS = [3.0, 1.0, 2.0]
#: Words lose a letter where this divides their checksum, so that there are variants to find.
PLANTED_EVERY = 199


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], turns.schema)
    return chat.example_digests(chat.prefix_target_examples(turns.unionByName(planted)))


def lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logfreq.lm_scores(_table(spark, sf_dir, "documents"))


def mixing_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.repetition_plan(_table(spark, sf_dir, "documents"), MIX_WEIGHTS)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.quality_verdicts(_table(spark, sf_dir, "documents"), statistics=True)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.select("doc_id", *rules.STATS, failed.alias("base_failed"), "kept")


def simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicate_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.piece_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(_table(spark, sf_dir, "documents"))


def toxicity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.code_report(_table(spark, sf_dir, "embeddings"))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_shared_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_groups(variants.counted_words(_table(spark, sf_dir, "documents"), planted_every=PLANTED_EVERY))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": chat_format,
    "op2_lm_scoring": lm_score,
    "op3_source_mixing": mixing_plan,
    "op4_quality_rules": quality_rules,
    "op5_simhash_dedup": simhash_dedup,
    "op6_byte_bpe": byte_bpe,
    "op7_token_counts": token_counts,
    "op8_language_id": language_id,
    "op9_toxicity": toxicity_score,
    "op10_nearest_vectors": nearest_vectors,
    "op11_vector_codes": vector_codes,
    "op12_line_dedup": line_dedup,
    "op13_spelling_variants": spelling_variants,
}

_MARKS = r"</?s>|\[/?(?:INST|ASST|SYS|ROLE)\]"


def _lloyd_sql(rounds: int) -> str:
    """Lloyd rounds in integers, one pair of common table expressions each."""

    def nearest(k: int) -> str:
        return f"""
        near{k} AS MATERIALIZED (
          SELECT r, p, CAST(min(far * 16 + e) % 16 AS INTEGER) AS e, min(far * 16 + e) // 16 AS far
          FROM (SELECT r, p, e, sum((x - b) * (x - b)) AS far FROM parts JOIN book{k} USING (p, i) GROUP BY ALL) GROUP BY ALL
        )"""

    def moved(k: int) -> str:
        return f"""
        book{k + 1} AS MATERIALIZED (
          SELECT p, e, i, coalesce(mean, b) AS b FROM book{k} LEFT JOIN (
            SELECT p, e, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS mean FROM near{k} JOIN parts USING (r, p) GROUP BY ALL
          ) USING (p, e, i)
        )"""

    steps = ",".join(nearest(k) + "," + moved(k) for k in range(rounds)) + "," + nearest(rounds)
    return f"""
        WITH kept AS (
          SELECT row_number() OVER () AS r, vec_id, label, embedding AS v, len(embedding) // 8 AS w FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), places AS (
          SELECT r, w, CAST(floor(4096 * CAST(unnest(v) AS DOUBLE)) AS BIGINT) AS x, generate_subscripts(v, 1) - 1 AS j FROM kept
        ), parts AS MATERIALIZED (
          SELECT r, j // w AS p, j % w AS i, x FROM places
        ), book0 AS MATERIALIZED (
          SELECT p, e, i, x AS b FROM parts JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 16) USING (r)
        ), {steps}
        , coded AS (
          SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM near{rounds} GROUP BY r
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
          (SELECT sha256(string_agg(CAST(b AS VARCHAR), ',' ORDER BY p, e, i)) FROM book{rounds}) AS codebooks_sha256
        FROM kept JOIN coded USING (r)
    """


ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": rf"""
        WITH rows AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL VALUES (-7, 0, 'user', '{CONTROL}'), (-7, 1, 'assistant', '{CONTROL}')
        ), measured AS (
          SELECT *, length(text) + len(regexp_extract_all(text, '{_MARKS}'))
            + CASE role WHEN 'user' THEN 22 WHEN 'assistant' THEN 22 WHEN 'system' THEN 20
              ELSE 22 + 15 + length(role) + len(regexp_extract_all(role, '{_MARKS}')) END AS piece
          FROM rows
        ), placed AS (
          SELECT *, sum(piece) OVER w AS upto, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n
          FROM measured WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
        )
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
          CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
          CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars,
          count(*) FILTER (role = 'assistant' OR k = n) AS n_examples,
          count(*) FILTER (role = 'assistant') AS n_targets
        FROM placed GROUP BY conv_id
    """,
    "op11_vector_codes": _lloyd_sql(vectorcodes.ROUNDS),
    "op12_line_dedup": """
        WITH rows AS (
          SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), lines AS (
          SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM rows
        ), keyed AS (
          SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
        ), shared AS (
          SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key
          HAVING count(DISTINCT doc_id) + CAST(count(*) > count(doc_id) AS INTEGER) >= 5
        ), judged AS (
          SELECT r, k.doc_id, pos, line, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.keeper AS gone FROM keyed k LEFT JOIN shared s USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
          sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY r, doc_id
    """,
}
