"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyproof.llm import chat_format, html_text, media, mixing, near_dup, quality_rules, sp_codec, suffix_dedup, token_prefix, toxicity
from tallyproof.llm.common import map_rows, read


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held_out())
    return found.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.encode(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_pieces", "ids_sha256", "nbest_scores", "nbest_sha256", "round_trip"
    )


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.media_of_texts(read(spark, sf_dir, "documents"))

    def start():
        sha = media.sha256_hex

        def work(ids, n_bytes, stored, payload, tiles, hashes):
            return (
                ids, n_bytes, list(map(len, payload)), list(map(sha, payload)), list(map(media.crc32_tail, payload)),
                list(map(len, stored)), list(map(sha, stored)), [f"dhash:{h} tile:{sha(t)[:16]}" for h, t in zip(hashes, tiles, strict=True)],
            )

        return work

    return map_rows(
        rows,
        start,
        "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


TOKEN_LIMIT = 4096


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_prefix.prefix_counts(read(spark, sf_dir, "documents"), budget=TOKEN_LIMIT).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "chars_within"
    )


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"), w=4)


#: Domains of a labelled document: toxic, else of high or of low quality.
DOMAINS = ("high", "low", "toxic")
#: Parts of all tokens that the domains are to have.
WEIGHTS = (0.80, 0.15, 0.05)


def domain():
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 1)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), domain(), list(WEIGHTS))
    return rows.select("doc_id", "tokens", *(F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(DOMAINS)), "rate", "copies")


#: A conversation whose texts hold what templates use as control strings.
CONFLICT = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    values = ", ".join(f"({c}L, {t}L, '{r}', '{x}')" for c, t, r, x in CONFLICT)
    rows = rows.unionByName(spark.sql(f"SELECT * FROM VALUES {values} AS t(conv_id, turn, role, text)"))
    done = chat_format.format_chats(rows).withColumn("turns", chat_format.parse(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    digest = done.select("conv_id", "n_escaped", F.size("turns").cast("bigint").alias("n_turns"), said.alias("said"), learned.alias("learned"), F.length("formatted").cast("bigint").alias("formatted_chars"))
    return digest.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_escaped",
    )


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(read(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_sentencepiece, op3_media_columns, op4_suffix_dedup, op5_quality_rules, op6_token_counts, op7_minhash_near_dedup, op8_mixing, op9_chat_format, op10_html_extraction,
    )
}

_STOPS = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))

ORACLE_SQL: dict[str, str] = {
    "op5_quality_rules": rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t
), g AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3
), g3 AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win FROM g
), rep AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g3
), hit AS (
  SELECT doc_id, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM rep WHERE n > 1
), r AS (
  SELECT doc_id, CAST(sum(least(3, coalesce(gap, 3))) AS BIGINT) AS n_repeat_words FROM hit GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(words, lambda x: lower(x) IN ({_STOPS}))) AS n_stop
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id
), b AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 16 AND n_symbols / greatest(n_words, 1) <= 0.10
       AND n_stop / greatest(n_words, 1) >= 0.01 AND n_dup_lines / greatest(n_lines, 1) <= 0.50
       AND n_repeat_words / greatest(n_words, 1) <= 0.50 AS kept
FROM b
""",
    "op9_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, (contains(role || chr(10) || text, '<s>') OR contains(role || chr(10) || text, '</s>')
    OR contains(role || chr(10) || text, '[INST]') OR contains(role || chr(10) || text, '[/INST]')) AS esc FROM rows
), f AS (
  SELECT *, CASE WHEN esc THEN replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') ELSE role END AS r,
    CASE WHEN esc THEN replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') ELSE text END AS x FROM e
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<s>+0' || r || '[INST]' || x || '[/INST]</s>')) AS BIGINT) AS formatted_chars,
  CAST(sum(CASE WHEN esc THEN 1 ELSE 0 END) AS BIGINT) AS n_escaped
FROM f GROUP BY conv_id
""",
}
