"""One query for each operator, over its whole table, and DuckDB SQL where that can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, chat, classifier, exact_dedup, lm_score, ngram_join, packing, pii, quality_rules, substring_dedup
from millrace.llm.common import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.find_repeats(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = chat.transcripts(table(spark, sf_dir, "conversations"))
    labelled = pieces.filter(F.coalesce(F.crc32(F.col("conv_id").cast("string")) % 5 != 2, F.lit(False)))
    return chat.format_chats(pieces.drop("role"), chat.fit(labelled))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    """Where the installed package of public tokenizers keeps ``name``."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_pii, op3_substring_dedup, op4_chat_formatting, op5_lm_scoring, op6_exact_dedup, op7_quality_rules, op8_best_fit_packing, op9_quality_classifier, op10_bpe)}
ORACLES: dict[str, str] = {
    "op6_exact_dedup": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t""",
    "op7_quality_rules": r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS lines FROM d),
grams AS (SELECT doc_id, i, list_slice(w, i, i + 2) AS g FROM w, unnest(range(1, len(w) - 1)) AS r(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) x WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
ln AS (SELECT doc_id, host, t, trim(lower(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm FROM w, unnest(lines) AS u(l)),
texts AS (SELECT host, count(DISTINCT t) AS n FROM d GROUP BY host),
frequent AS (SELECT ln.host, norm FROM ln JOIN texts ON ln.host = texts.host WHERE norm <> '' GROUP BY ln.host, norm, texts.n HAVING count(DISTINCT t) > 20 AND count(DISTINCT t) > texts.n * 0.01),
gone AS (SELECT ln.doc_id, sum(len(string_split(ln.norm, ' '))) AS n FROM ln JOIN frequent f ON ln.host = f.host AND ln.norm = f.norm GROUP BY ln.doc_id),
s AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(lines, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(lines, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words
  FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id LEFT JOIN gone ON w.doc_id = gone.doc_id)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_words < n_words * 0.7 AS kept FROM s""",
}
