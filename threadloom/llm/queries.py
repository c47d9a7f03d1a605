"""The registered queries of this subpackage, one per operator, and their SQL.

Each applies its operator to a whole table and derives the digest columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import bpe, embeddings, html_text, mixing, quality_model, rules, secrets, simhash, token_counts, token_output


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.deduplicate(table(spark, sf_dir, "documents"), width=3)
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = rules.stored(table(spark, sf_dir, "documents"))
    spared = rules.ablation(book, rules.STRICT).select(F.col("rule").alias("only_rule"), F.col("failed_alone").alias("n_only_rule"))  # a row a rule
    book = rules.apply(book, rules.BASE, rules.STRICT, rules.PLAIN).withColumn("only_rule", rules.alone(rules.STRICT)).join(F.broadcast(spared), "only_rule", "left")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return book.select("doc_id", *counts, (~F.col("kept_base")).alias("base_failed"), F.col("kept_v1").alias("kept"), "fail_bits", "kept_v2", "only_rule", "n_only_rule")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.drop("ids")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_output, op2_simhash, op3_embedding_dedup, op4_quality_model, op5_mixing, op6_html_text, op7_rules, op8_token_counts, op9_bpe, op10_secrets)}

MIXING_SQL = """
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w
  FROM docs GROUP BY source
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY CAST(3 * n AS DOUBLE) / w, source NULLS LAST) AS pos FROM sizes
), sums AS (
  SELECT *, CAST(sum(n) OVER () - 3 * coalesce(sum(n) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest_n,
         CAST(sum(w) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest_w
  FROM ordered
), cut AS (
  SELECT min_by(struct_pack(pos := pos, n := rest_n, w := rest_w), pos) AS c FROM sums WHERE rest_n * w <= 3 * n * rest_w
), due AS (
  SELECT source, n, CASE WHEN pos < c.pos THEN CAST(3 * n AS DOUBLE) ELSE w * (CAST(c.n AS DOUBLE) / CAST(c.w AS DOUBLE)) END AS target FROM sums, cut
), plan AS (
  SELECT *, CASE WHEN n = 0 THEN 0 ELSE CAST(floor(least(3.0::DOUBLE, target / n)) AS BIGINT) END AS whole FROM due
), plan2 AS (
  SELECT *, target - CAST(whole * n AS DOUBLE) AS rest FROM plan
), pool AS (
  SELECT d.doc_id, d.source, d.size, p.rest,
         (CAST(CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR) || '-7'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u,
         sum(d.size) OVER (PARTITION BY d.source) AS drawable
  FROM docs d JOIN plan2 p ON d.source IS NOT DISTINCT FROM p.source WHERE d.size > 0 AND d.size <= p.rest
), ranked AS (
  SELECT *, u / (1 - u) / (odds / (1 + odds) / (1 - odds / (1 + odds))) AS rank
  FROM (SELECT *, chance / (1 - chance) AS odds FROM (SELECT *, least(0.999999999::DOUBLE, rest / CAST(drawable AS DOUBLE)) AS chance FROM pool))
), pass1 AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, u, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM ranked
), due2 AS (
  SELECT source, max(rest) - coalesce(sum(size) FILTER (upto <= rest), 0) AS due FROM pass1 GROUP BY source
), pass2 AS (
  SELECT p.doc_id, p.source, p.size, p.rank, p.u, d.due, sum(p.size) OVER (PARTITION BY p.source ORDER BY rank, u, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM pass1 p JOIN due2 d ON p.source IS NOT DISTINCT FROM d.source WHERE p.upto > p.rest AND p.size <= d.due
), due3 AS (
  SELECT source, max(due) - coalesce(sum(size) FILTER (upto <= due), 0) AS due FROM pass2 GROUP BY source
), left3 AS (
  SELECT p.doc_id, p.source, p.size, p.rank, p.u FROM pass1 p
  WHERE p.upto > p.rest AND p.doc_id NOT IN (SELECT doc_id FROM pass2 WHERE upto <= due)
), pass3 AS (
  SELECT l.doc_id, l.size, coalesce(d3.due, d2.due) AS due, sum(l.size) OVER (PARTITION BY l.source ORDER BY rank, u, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM left3 l JOIN due2 d2 ON l.source IS NOT DISTINCT FROM d2.source LEFT JOIN due3 d3 ON l.source IS NOT DISTINCT FROM d3.source
  WHERE l.size <= coalesce(d3.due, d2.due)
), drawn AS (
  SELECT doc_id FROM pass1 WHERE upto <= rest UNION ALL SELECT doc_id FROM pass2 WHERE upto <= due UNION ALL SELECT doc_id FROM pass3 WHERE upto <= due
)
SELECT d.doc_id, d.size, p.n AS source_size, p.target,
       CAST((p.whole + CASE WHEN w.doc_id IS NULL THEN 0 ELSE 1 END) * d.size AS BIGINT) AS taken
FROM docs d JOIN plan2 p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN drawn w ON d.doc_id = w.doc_id
"""

RULES_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM t WHERE len(ws) >= 3)
), again AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS c FROM win) WHERE c >= 2
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id
), lines AS (
  SELECT doc_id, len(l) AS n, len(l) - len(list_distinct(l)) AS dup
  FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t)
), m AS (
  SELECT t.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, lines.n AS n_lines, CAST(lines.dup AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) AS n_upper
  FROM t JOIN lines ON t.doc_id = lines.doc_id LEFT JOIN covered c ON t.doc_id = c.doc_id
), f AS (
  SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars > 14 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 16 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END
    + CASE WHEN n_letters > 0 AND 100 * n_upper > 60 * n_letters THEN 64 ELSE 0 END
    + CASE WHEN n_words > 0 AND 2 * n_letters < word_chars THEN 128 ELSE 0 END AS BIGINT) AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits, fail_bits & 63 = 0 AS kept_v2,
  CASE fail_bits WHEN 1 THEN 'too_few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'short_words' WHEN 8 THEN 'long_words' WHEN 16 THEN 'symbols' WHEN 32 THEN 'repeated_lines' WHEN 64 THEN 'upper_case' WHEN 128 THEN 'no_letters' END AS only_rule,
  CASE WHEN fail_bits IN (1, 2, 4, 8, 16, 32, 64, 128) THEN count(*) OVER (PARTITION BY fail_bits) END AS n_only_rule FROM f
"""

EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98
), reach AS (
  SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), least AS (
  SELECT u, min(v) AS v FROM reach GROUP BY u
), counts AS (
  SELECT u, count(*) AS n FROM links GROUP BY u
)
SELECT vec_id, coalesce(counts.n, 0) AS n_links, least(vec_id, coalesce(l.v, vec_id)) AS component_id, vec_id <= coalesce(l.v, vec_id) AS kept
FROM v LEFT JOIN least l ON vec_id = l.u LEFT JOIN counts ON vec_id = counts.u
"""

ORACLE_SQL: dict[str, str] = {"op3_embedding_dedup": EMBEDDING_SQL, "op5_mixing": MIXING_SQL, "op7_rules": RULES_SQL}
