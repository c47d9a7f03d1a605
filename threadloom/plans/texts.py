"""Queries about text measures and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import sentiment, text
from threadloom.operators.relational import rounded
from threadloom.plans.registry import query
from threadloom.sources import pages
from threadloom.sources.fixtures import forum_text
from threadloom.sources.tables import table

STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


def _tokens_sql(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '\\p{{L}}+')"


SENTENCES_SQL = "CASE WHEN regexp_matches(text, '\\S') THEN greatest(len(regexp_extract_all(text, '[.!?]+(\\s|$)')), 1) ELSE 0 END"


@query(f"""SELECT doc_id, CAST(len(regexp_extract_all(text, '\\p{{P}}')) AS BIGINT) AS num_punct,
CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) - CASE WHEN ends_with(text, ' ') THEN 1 ELSE 0 END END AS BIGINT) AS num_words,
CAST(CASE WHEN text = '' THEN 0 ELSE len(list_distinct(string_split(CASE WHEN ends_with(text, ' ') THEN text[:-2] ELSE text END, ' '))) END AS BIGINT) AS num_words_unique,
length(text) AS num_char, CAST({SENTENCES_SQL} AS BIGINT) AS num_sentences FROM documents""")
def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.punctuation("text").alias("num_punct"), text.words("text").alias("num_words"), text.unique_words("text").alias("num_words_unique"), text.characters("text").alias("num_char"), text.sentences("text").alias("num_sentences"))


@query(f"WITH t AS (SELECT doc_id, list_filter({_tokens_sql('text')}, lambda x: x NOT IN ({STOP})) AS t FROM documents) SELECT doc_id, round(CASE WHEN len(t) < 2 THEN 0.0::DOUBLE ELSE len(list_distinct(t)) / sqrt(2.0::DOUBLE * len(t)) END, 6) + 0.0 AS cttr FROM t")
def cttr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.cttr(text.tokens("text")).alias("cttr")))


@query(f"""WITH p AS (SELECT doc_id, len(list_filter({_tokens_sql('text')}, lambda w: len(regexp_extract_all(w, '[{text.VOWELS}]+')) >= 3)) AS poly, {SENTENCES_SQL} AS s FROM documents WHERE lang = 'de')
SELECT doc_id, round(coalesce(sqrt(30.0::DOUBLE * poly / nullif(s, 0)) - 2, -2.0::DOUBLE), 6) + 0.0 AS smog FROM p""")
def smog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents", "doc_id", "text", "lang").filter("lang = 'de'")
    return rounded(rows.select("doc_id", text.smog("text").alias("smog")))


RATIOS_SQL = f"""SELECT doc_id, round(length(text) / nullif({SENTENCES_SQL}, 0), 6) + 0.0 AS char_to_sent,
round(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) - CASE WHEN ends_with(text, ' ') THEN 1 ELSE 0 END END / nullif({SENTENCES_SQL}, 0), 6) + 0.0 AS word_to_sent FROM documents"""


@query(RATIOS_SQL)
def sentence_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(text.with_features(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "char_to_sent", "word_to_sent"))


@query(RATIOS_SQL)
def sentence_ratios_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also of documents that are empty or end with a space."""
    return rounded(text.with_features(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "char_to_sent", "word_to_sent"))


@query("SELECT doc_id, regexp_matches(text, '(^|[^\\p{L}\\p{N}_])(Du|Sie|du)([^\\p{L}\\p{N}_]|$)') AS second_person FROM documents")
def second_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.second_person("text").alias("second_person"))


@query(f"""WITH d AS (SELECT source AS article, doc_id, doc_id = min(doc_id) OVER (PARTITION BY source) AS first, text FROM documents), tok AS (SELECT article, doc_id, first, unnest({_tokens_sql('text')}) AS term FROM d),
tf AS (SELECT article, doc_id, first, term, count(*) AS tf FROM tok GROUP BY ALL), c AS (SELECT article, term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY ALL HAVING sum(tf) >= 2), n AS (SELECT article, count(*) AS n FROM d GROUP BY 1),
w AS (SELECT tf.article, doc_id, first, tf.term, tf * log10(n::DOUBLE / df) AS w FROM tf JOIN c ON tf.article = c.article AND tf.term = c.term JOIN n ON n.article = tf.article),
norm AS (SELECT article, doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL), a AS (SELECT article, term, w AS wa FROM w WHERE first), an AS (SELECT d.article, norm FROM d JOIN norm ON d.article = norm.article AND d.doc_id = norm.doc_id WHERE d.first),
dot AS (SELECT w.article, w.doc_id, sum(w * wa) AS dot FROM w JOIN a ON w.article = a.article AND w.term = a.term WHERE NOT first GROUP BY ALL)
SELECT d.article, d.doc_id AS comment_id, round(coalesce(dot / nullif(norm.norm * an.norm, 0.0), 0.0), 5) + 0.0 AS cosine FROM d LEFT JOIN dot ON dot.article = d.article AND dot.doc_id = d.doc_id LEFT JOIN norm ON norm.article = d.article AND norm.doc_id = d.doc_id LEFT JOIN an ON an.article = d.article WHERE NOT d.first""")
def tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forum_text(spark, sf_dir)
    first = rows.groupBy("article").agg(F.min("comment_id").alias("_first"))
    marked = rows.join(first, "article").withColumn("is_article", F.col("comment_id") == F.col("_first")).drop("_first")
    return rounded(text.cosine_to_first(marked), 5)


@query("SELECT page_id, len(l) AS n_links, l[1] AS first_link FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1) AS l FROM pages)")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages", "page_id", "html").withColumn("l", pages.links("html"))
    return rows.select("page_id", F.size("l").cast("long").alias("n_links"), F.expr("try_element_at(l, 1)").alias("first_link"))


@query()
def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.articles(table(spark, sf_dir, "pages", "page_id", "html"))


@query("""SELECT doc_id, source AS title, lang AS subtitle, concat('2022-10-', lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0')) AS "date", md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text,
concat('/', source) AS genre1, CASE WHEN doc_id % 2 = 0 THEN concat('/', source, '/', lang) END AS genre2, CAST(NULL AS VARCHAR) AS genre3 FROM documents""")
def article_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document spelled as an article's page, a paragraph a line, and read back; the text is shown by its hash."""
    rows = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    told = F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;")
    second = F.when(F.col("doc_id") % 2 == 0, F.format_string('<a href="/%s/%s">b</a>', "source", "lang")).otherwise(F.lit(""))
    head = F.format_string('<nav><a href="/%s">a</a>%s</nav><h1> %s </h1><h2>%s</h2><time datetime="2022-10-%02d">x</time><article><p>', "source", second, "source", "lang", F.col("doc_id") % 28 + 1)
    found = pages.articles(rows.select("doc_id", F.concat(head, F.regexp_replace(told, "\\n", "</p><p>"), F.lit("</p></article>")).alias("html")))
    return found.withColumn("text", F.md5("text"))


def _listed_sql(kind: list[str]) -> str:
    words = ", ".join(f"'{w}'" for w in kind)
    return f"len(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: trim(w, '.,!?') IN ({words})))"


@query(f"""WITH c AS (SELECT doc_id, 1 + {_listed_sql(sentiment.POSITIVE)} AS p, 1 + {_listed_sql(sentiment.NEGATIVE)} AS n FROM documents),
s AS (SELECT doc_id, p::DOUBLE / (p + n + 1) AS pos, n::DOUBLE / (p + n + 1) AS neg, 1::DOUBLE / (p + n + 1) AS neu FROM c)
SELECT doc_id, pos AS sentiment_prob_pos, neg AS sentiment_prob_neg, neu AS sentiment_prob_neu, CASE WHEN pos >= neg AND pos >= neu THEN 'positive' WHEN neg >= neu THEN 'negative' ELSE 'neutral' END AS sentiment_class,
CAST(CASE WHEN pos >= neg AND pos >= neu THEN 2 WHEN neg >= neu THEN 0 ELSE 1 END AS INT) AS sentiment_class_c, pos - neg + 1 AS sentiment_compound FROM s""")
def sentiment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.with_sentiment(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")


@query("""WITH p AS (SELECT event_id, (CAST(event_id % 7 AS DOUBLE) + 1) / 20 AS pos, (CAST(event_id % 5 AS DOUBLE) + 1) / 20 AS neg FROM events), q AS (SELECT *, 1 - pos - neg AS neu FROM p)
SELECT event_id, CASE WHEN pos >= neg AND pos >= neu THEN 'positive' WHEN neg >= neu THEN 'negative' ELSE 'neutral' END AS sentiment_class, CASE WHEN pos >= neg AND pos >= neu THEN 2 WHEN neg >= neu THEN 0 ELSE 1 END AS sentiment_class_c, round(pos - neg + 1, 6) + 0.0 AS sentiment_compound FROM q""")
def sentiment_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events", "event_id").withColumns({"sentiment_prob_pos": ((F.col("event_id") % 7).cast("double") + 1) / 20, "sentiment_prob_neg": ((F.col("event_id") % 5).cast("double") + 1) / 20})
    rows = rows.withColumn("sentiment_prob_neu", 1 - F.col("sentiment_prob_pos") - F.col("sentiment_prob_neg"))
    return rounded(rows.withColumns(sentiment.classes()).select("event_id", "sentiment_class", "sentiment_class_c", "sentiment_compound"))
