"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, langid, media, mixing, pii, quality, sharding, simhash, substring_dedup
from .storage import materialise

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeated_windows(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(_table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = quality.rejected(quality.BASE)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~quality.rejected(quality.STANDARD)).alias("kept"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = media.draw_vectors(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return media.copies(drawn, "vec_id", "media").select(F.col("id").alias("vec_id"), "n_keypoints", "n_contents", "group_id")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[pii.count_of("pii_base", k).alias(f"n_{k}") for k in pii.KINDS], F.sha2(pii.joined("pii_base"), 256).alias("base_sha256"), pii.joined("pii_spans").alias("spans"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = materialise(mixing.with_size(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")), "mix-sized")
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    samples = langid.fit_samples(docs.where(langid.learned()))
    return langid.predict(docs.select("doc_id", langid.held_out().alias("held_out"), "text"), samples)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_table(spark, sf_dir, "conversations")).select("conv_id", "segment", "perspective", "n_messages", "n_trained", "start", "rendered", chat.mask_text().alias("mask_spans"))


QUERIES = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_sharding, op3_quality_rules, op4_media_columns, op5_pii, op6_mixing, op7_byte_bpe, op8_language_id, op9_simhash, op10_chat_formatting)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL = {
    "op1_substring_dedup": rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, {_WORDS} AS w FROM documents),
win AS (SELECT k, i, sha256(list_aggregate(w[i:i + 34], 'string_agg', ' ')) AS h FROM (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
word AS (SELECT k, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
cov AS (SELECT word.k, word.i, word.word, max(rep.i) OVER (PARTITION BY word.k ORDER BY word.i ROWS UNBOUNDED PRECEDING) AS last FROM word LEFT JOIN rep ON rep.k = word.k AND rep.i = word.i),
agg AS (SELECT k, count(*) FILTER (WHERE i - last < 35) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE last IS NULL OR i - last >= 35), '') AS kept FROM cov GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN agg ON agg.k = d.k""",
    "op3_quality_rules": rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
lines AS (SELECT k, sum(n - 1)::BIGINT AS dup, sum(n)::BIGINT AS n_lines FROM (SELECT k, line, count(*) AS n FROM (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY k),
win AS (SELECT k, i, count(*) OVER (PARTITION BY k, x) AS n FROM (SELECT k, i, w[i:i + 4] AS x FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5))),
inside AS (SELECT k, count(DISTINCT j)::BIGINT AS rep FROM (SELECT k, unnest(range(i, i + 5)) AS j FROM win WHERE n > 1) GROUP BY k),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep, 0)::BIGINT AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_exclaim
  FROM d LEFT JOIN lines USING (k) LEFT JOIN inside USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_upper > 40 * word_chars OR 100 * n_exclaim > 50 * n_words OR word_chars > 20 * n_words OR 2 * word_chars < 3 * n_words) AS kept
FROM m""",
    "op10_chat_formatting": r"""
WITH said AS (SELECT CASE WHEN conv_id IS NULL THEN 'row ' || row_number() OVER () ELSE 'conversation ' || conv_id END AS dialogue, conv_id, floor(turn / 512) AS part, turn, coalesce(role, 'unknown') AS speaker,
  replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS body FROM conversations),
people AS (SELECT DISTINCT dialogue, speaker AS perspective FROM said WHERE speaker <> 'system'),
seen AS (SELECT *, speaker = perspective AS own, dense_rank() OVER (PARTITION BY dialogue ORDER BY part NULLS LAST) - 1 AS segment,
  CASE WHEN speaker = 'system' THEN '<|system|>' WHEN speaker = perspective THEN '<|assistant|>' ELSE '<|user name=' || replace(replace(speaker, '<|', '< |'), '|>', '| >') || '|>' END AS head
  FROM said JOIN people USING (dialogue)),
placed AS (SELECT *, row_number() OVER w AS place, sum(length(head) + length(body)) OVER (w ROWS UNBOUNDED PRECEDING) AS stop FROM seen WINDOW w AS (PARTITION BY dialogue, perspective ORDER BY turn NULLS LAST, speaker, body))
SELECT conv_id, segment, perspective, count(*)::BIGINT AS n_messages, count(*) FILTER (WHERE own)::BIGINT AS n_trained, min(stop - length(head) - length(body))::BIGINT AS start, string_agg(head || body, '' ORDER BY place) AS rendered,
  coalesce(string_agg((stop - length(body))::VARCHAR || ':' || stop::VARCHAR, ',' ORDER BY place) FILTER (WHERE own), '') AS mask_spans
FROM placed GROUP BY dialogue, conv_id, segment, perspective""",
}
