"""Queries of the relational layer: joins, counts, windows, casts, times, reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import maths, values
from threadloom.functions.text import stars, three_decimals
from threadloom.operators import relational as R
from threadloom.plans.registry import query
from threadloom.sources import tables as T
from threadloom.sources.fixtures import ARTICLES_SQL, FORUM_SQL, articles_join, forum_ranking
from threadloom.sources.tables import table

NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(f"WITH {ARTICLES_SQL} SELECT l_orderkey, l_linenumber, l_suppkey, round(greatest(0.0::DOUBLE, (epoch(l_shipdate) - epoch(o_orderdate)) / 3600.0::DOUBLE), 6) + 0.0 AS hours FROM joined")
def article_join_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rounded(articles_join(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_suppkey", values.hours_since("l_shipdate", "o_orderdate").alias("hours")))


@query(f"WITH {ARTICLES_SQL} SELECT genre1, coalesce(genre2, genre1) AS genre2, coalesce(genre3, genre2, genre1) AS genre3, count(*) AS n FROM joined GROUP BY ALL")
def coalesce_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values.coalesce_chain(articles_join(spark, sf_dir), "genre1", "genre2", "genre3").groupBy("genre1", "genre2", "genre3").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey AS article, l_orderkey, l_linenumber, l_partkey, count(*) OVER w AS n_comments, round(avg(l_quantity) OVER w, 6) + 0.0 AS mean_votes, round(avg(l_tax) OVER w, 6) + 0.0 AS mean_down FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)")
def per_article_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax")
    means = rows.groupBy("l_suppkey").agg(F.count("*").alias("n_comments"), F.avg("l_quantity").alias("mean_votes"), F.avg("l_tax").alias("mean_down"))
    # a row an article goes to the rows: a hot article's rows are split as any skewed side of a join
    return R.rounded(rows.join(means, "l_suppkey").select(F.col("l_suppkey").alias("article"), "l_orderkey", "l_linenumber", "l_partkey", "n_comments", "mean_votes", "mean_down"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, ln(l_quantity + 1) AS q, ln(l_extendedprice + 1) AS p FROM lineitem), s AS (SELECT avg(q) AS mq, stddev_samp(q) AS sq, avg(p) AS mp, stddev_samp(p) AS sp FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, round((q - mq) / sq, 5) + 0.0 AS q, round((p - mp) / sp, 5) + 0.0 AS p FROM x, s""")
def zscore_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    logged = maths.log_columns(rows, "l_quantity", "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity_log").alias("q"), F.col("l_extendedprice_log").alias("p"))
    return R.rounded(R.standardised(logged, ["q", "p"]), 5)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def first_row_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_per_group(table(spark, sf_dir, "events", "user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query(f"WITH {ARTICLES_SQL} SELECT genre1, count(*) AS n, count(DISTINCT l_suppkey) AS articles, round(sum(l_quantity), 4) + 0.0 AS votes, round(avg(l_tax), 6) + 0.0 AS down FROM joined GROUP BY genre1")
def genre_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = articles_join(spark, sf_dir).groupBy("genre1").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("articles"), F.round(F.sum("l_quantity"), 4).alias("votes"), F.round(F.avg("l_tax"), 6).alias("down"))
    return grouped


@query("SELECT a, b, round(r, 5) + 0.0 AS r FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN abs(corr({a}, {b})) > 0.01 THEN corr({a}, {b}) END AS r FROM lineitem" for a in NUMBERS for b in NUMBERS) + ")")
def corr_matrix_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rounded(R.correlations(table(spark, sf_dir, "lineitem", *NUMBERS), list(NUMBERS), 0.01), 5)


@query("""WITH m AS (SELECT l_suppkey AS k, avg(l_quantity) AS a, avg(l_extendedprice) AS b FROM lineitem GROUP BY 1), r AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM m)
SELECT round(corr(a, b), 5) + 0.0 AS pearson, round(corr(ra, rb), 5) + 0.0 AS spearman, count(*) AS n FROM r""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = table(spark, sf_dir, "lineitem", "l_suppkey", "l_quantity", "l_extendedprice").groupBy("l_suppkey").agg(maths.exact_mean("l_quantity").alias("a"), maths.exact_mean("l_extendedprice").alias("b"))
    return R.rounded(R.spearman(means, "a", "b"), 5)


@query("SELECT CAST(CASE WHEN l_quantity < 0 THEN 0 WHEN l_quantity >= 50 THEN 11 ELSE floor(l_quantity / 5) + 1 END AS BIGINT) AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def histogram_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.histogram(table(spark, sf_dir, "lineitem", "l_quantity"), "l_quantity", 0.0, 50.0, 10)


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", min({c}) + 0.0 AS "min", round(quantile_cont({c}, 0.25), 6) + 0.0 AS q25, round(quantile_cont({c}, 0.5), 6) + 0.0 AS median, round(quantile_cont({c}, 0.75), 6) + 0.0 AS q75, round(avg({c}), 5) + 0.0 AS mean, max({c}) + 0.0 AS "max" FROM lineitem""" for c in NUMBERS))
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.profile(table(spark, sf_dir, "lineitem", *NUMBERS))
    return R.rounded(found).withColumn("mean", F.round("mean", 5))


@query("SELECT genre, CAST(day AS DATE) AS day, 'https://news.example' || genre || '/' || strftime(day, '%Y/%-m/%-d') AS url FROM (SELECT unnest(['/inland', '/sport']) AS genre), (SELECT unnest(generate_series(DATE '2022-09-28', DATE '2022-10-03', INTERVAL 1 DAY)) AS day)")
def url_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.frontier(spark, "2022-09-28", "2022-10-03", "https://news.example", ["/inland", "/sport"])


@query("""SELECT user_id, avg(value) AS x, CASE WHEN avg(value) < 9.5 THEN 'low' WHEN avg(value) < 10.5 THEN 'mid' END AS name, CASE WHEN avg(value) < 9.5 THEN 0 WHEN avg(value) < 10.5 THEN 1 END AS code, coalesce(CASE WHEN avg(value) < 9.5 THEN 'Low' END, CASE WHEN avg(value) < 10.5 THEN 'mid' END) AS display
FROM (SELECT user_id, round(avg(value), 4) + 0.0 AS value FROM events GROUP BY user_id) GROUP BY user_id""")
def codes_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = table(spark, sf_dir, "events", "user_id", "value").groupBy("user_id").agg((F.round(F.avg("value"), 4) + 0.0).alias("x"))
    named = means.withColumn("name", F.when(F.col("x") < 9.5, "low").when(F.col("x") < 10.5, "mid"))
    return values.display(named.withColumn("code", values.code("name", {"low": 0, "mid": 1})), "name", {"low": "Low"}, "display")


@query("""SELECT event_id, event_type IN ('click', 'view') AS listed, contains(event_type, 'o') AS has_o, starts_with(event_type, 'p') AS starts_p, CAST(event_type = 'purchase' AS INT) AS bought, TRY_CAST(regexp_extract(props, '[0-9]+') AS INT) AS k, substr(event_type, 2, 3) AS part, replace(event_type, 'c', 'k') AS spelled FROM events WHERE event_type <> 'error'""")
def filters_and_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events", "event_id", "event_type", "props").filter(F.col("event_type") != "error").withColumn("_k", F.regexp_extract("props", r"[0-9]+", 0))
    t = F.col("event_type")
    return rows.select("event_id", t.isin("click", "view").alias("listed"), t.contains("o").alias("has_o"), t.startswith("p").alias("starts_p"), (t == "purchase").cast("int").alias("bought"), values.integer("_k").alias("k"), F.substring(t, 2, 3).alias("part"), F.regexp_replace(t, "c", "k").alias("spelled"))


@query("""SELECT event_id, CASE WHEN lower(v) IN ('1', 'true') THEN true WHEN lower(v) IN ('0', 'false') THEN false END AS flag FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'True' WHEN 1 THEN '0' WHEN 2 THEN 'FALSE' WHEN 3 THEN '1' ELSE 'NA' END AS v FROM events)""")
def boolean_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    v = F.when(k == 0, "True").when(k == 1, "0").when(k == 2, "FALSE").when(k == 3, "1").otherwise("NA")
    return table(spark, sf_dir, "events", "event_id").select("event_id", values.boolean(v).alias("flag"))


@query("""WITH m AS (SELECT l_returnflag AS k, avg(l_quantity) AS a, avg(l_discount) * 500 AS b, avg(l_tax) * 600 AS c FROM lineitem GROUP BY 1), l AS (UNPIVOT m ON a, b, c INTO NAME model VALUE value)
SELECT k, model, round(value, 4) + 0.0 AS value, CAST(rank() OVER (PARTITION BY k ORDER BY value) AS INT) AS place FROM l""")
def row_rank_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rounded(R.row_rank(_three_means(spark, sf_dir), ["k"], ["a", "b", "c"]), 4)


def _three_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity", "l_discount", "l_tax")
    return rows.groupBy(F.col("l_returnflag").alias("k")).agg(F.avg("l_quantity").alias("a"), (F.avg("l_discount") * 500).alias("b"), (F.avg("l_tax") * 600).alias("c"))


@query("""WITH m AS (SELECT l_returnflag AS k, avg(l_quantity) AS a, avg(l_discount) * 500 AS b, avg(l_tax) * 600 AS c FROM lineitem GROUP BY 1)
SELECT k, round(list_sort([a, b, c])[1], 4) + 0.0 AS best, round(list_sort([a, b, c])[2], 4) + 0.0 AS second, round(b - a, 4) + 0.0 AS b_delta, round(c - a, 4) + 0.0 AS c_delta FROM m""")
def bic_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rounded(R.baseline_difference(R.two_smallest(_three_means(spark, sf_dir), ["a", "b", "c"]), ["b", "c"], "a").select("k", "best", "second", "b_delta", "c_delta"), 4)


@query("""WITH m AS (SELECT l_returnflag AS k, avg(l_quantity) AS v FROM lineitem GROUP BY 1) SELECT CAST(0 AS INT) AS ord, k, round(v, 4) + 0.0 AS v FROM m WHERE k = 'R' UNION ALL SELECT 1, k, round(v, 4) + 0.0 FROM m WHERE k = 'A'""")
def label_ordered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = table(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity").groupBy(F.col("l_returnflag").alias("k")).agg((F.round(F.avg("l_quantity"), 4) + 0.0).alias("v"))
    return R.labelled_lookup(means, "k", ["R", "A"]).select("ord", "k", "v")


@query("""WITH a AS (SELECT n_regionkey AS k, count(*) AS n FROM nation WHERE n_nationkey < 12 GROUP BY 1), b AS (SELECT n_regionkey AS k, max(n_name) AS n FROM nation WHERE n_nationkey > 20 GROUP BY 1), c AS (SELECT r_regionkey AS k, r_name AS n FROM region WHERE r_regionkey <> 2)
SELECT k, a.n AS few, b.n AS last, c.n AS region FROM a FULL JOIN b USING (k) FULL JOIN c USING (k)""")
def outer_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    few = nation.filter("n_nationkey < 12").groupBy(F.col("n_regionkey").alias("k")).agg(F.count("*").alias("n"))
    last = nation.filter("n_nationkey > 20").groupBy(F.col("n_regionkey").alias("k")).agg(F.max("n_name").alias("n"))
    return R.aligned([("few", few), ("last", last), ("region", region.filter("r_regionkey <> 2").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("n")))], "k", "n")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0) GROUP BY ALL")
def membership_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus")
    urgent = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").filter("o_orderpriority = '1-URGENT'")
    thirds = table(spark, sf_dir, "supplier", "s_suppkey").filter("s_suppkey % 3 = 0")
    kept = lines.join(urgent, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").join(thirds, F.col("l_suppkey") == F.col("s_suppkey"), "left_anti")
    return kept.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag AS flag, CAST(l_returnflag = 'A' AS INT) AS flag_A, CAST(l_returnflag = 'R' AS INT) AS flag_R, count(*) AS n FROM lineitem GROUP BY ALL")
def one_hot_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", "l_returnflag").withColumnRenamed("l_returnflag", "flag")
    return R.dummies(rows, "flag", ["A", "N", "R"], base="N").groupBy("flag", "flag_A", "flag_R").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS order_all, strftime(o_orderdate, '%Y-%m-%d') AS day, round(ln(o_totalprice), 6) + 0.0 AS log_price FROM orders")
def global_row_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.global_number(table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_totalprice"), "o_orderdate", ["o_orderkey"], "order_all")
    return R.rounded(rows.select("o_orderkey", "order_all", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), maths.positive_log("o_totalprice").alias("log_price")))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS order_all FROM orders")
def global_row_number_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all orders, without a date at which they end."""
    return R.global_number(table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate"), "o_orderdate", ["o_orderkey"], "order_all").select("o_orderkey", "order_all")


@query("""WITH m AS (SELECT l_suppkey AS k, avg(l_quantity) AS e, stddev_samp(l_quantity) / sqrt(count(*)) AS s FROM lineitem GROUP BY 1)
SELECT k, round(e - 1.96 * s, 5) + 0.0 AS ci_lower_95, round(e + 1.96 * s, 5) + 0.0 AS ci_upper_95, round(e - 2.576 * s, 5) + 0.0 AS ci_lower_99, round(e + 2.576 * s, 5) + 0.0 AS ci_upper_99, round((exp(s) - 1) / (exp(s) + 1), 5) + 0.0 AS change, round(least(greatest((s + 1) / 2, 0.01), 0.99), 5) + 0.0 AS squeezed,
CASE WHEN s < 0.6 THEN '**' WHEN s < 0.62 THEN '*' ELSE '' END AS mark, printf('%.3f', e) AS shown FROM m""")
def intervals_and_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = table(spark, sf_dir, "lineitem", "l_suppkey", "l_quantity").groupBy(F.col("l_suppkey").alias("k")).agg(F.avg("l_quantity").alias("estimate"), (F.stddev_samp("l_quantity") / F.sqrt(F.count("*"))).alias("std_error"))
    p = F.when(F.col("std_error") < 0.6, 0.005).when(F.col("std_error") < 0.62, 0.02).otherwise(0.5)
    out = maths.intervals(means).withColumns({"change": maths.score_change("std_error"), "squeezed": maths.squeeze("std_error", 0.01), "mark": stars(p), "shown": three_decimals(F.col("estimate"))})
    return R.rounded(out.drop("estimate", "std_error"), 5)


@query("""SELECT event_id, strptime(s, '%d.%m.%Y, %H:%M:%S') AS parsed FROM (SELECT event_id, strftime(ts, '%d.%m.%Y, %H:%M:%S') AS s FROM events)""")
def german_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times spelled with German months, and parsed again."""
    names = F.array(*map(F.lit, "Jänner Feb. März Apr. Mai Juni Juli Aug. Sep. Okt. Nov. Dez.".split()))
    spelled = F.concat(F.dayofmonth("ts").cast("string"), F.lit(". "), F.element_at(names, F.month("ts")), F.lit(" "), F.year("ts").cast("string"), F.lit(", "), F.date_format("ts", "HH:mm:ss"))
    return table(spark, sf_dir, "events", "event_id", "ts").withColumn("s", spelled).select("event_id", values.german_time("s").alias("parsed"))


@query(f"WITH {FORUM_SQL}, f AS (SELECT article, comment_id, votes_pos, votes_neg FROM forum) SELECT article, CAST(sum(votes_pos) AS BIGINT) AS up, CAST(sum(votes_neg) AS BIGINT) AS down, round(sum(votes_pos) / nullif(sum(votes_pos) + sum(votes_neg), 0), 6) + 0.0 AS share, round(count(*) FILTER (votes_neg > 0) / count(*), 6) + 0.0 AS any_down FROM f GROUP BY article")
def vote_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = forum_ranking(spark, sf_dir).groupBy("article").agg(F.sum("votes_pos").alias("up"), F.sum("votes_neg").alias("down"), (F.count_if(F.col("votes_neg") > 0) / F.count("*")).alias("any_down"))
    return R.rounded(sums.withColumn("share", F.col("up") / F.nullif(F.col("up") + F.col("down"), F.lit(0))))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), f AS (SELECT label, min_by(v, vec_id) AS c FROM e GROUP BY label)
SELECT vec_id, round(list_dot_product(v, c) / sqrt(list_dot_product(v, v) * list_dot_product(c, c)), 5) + 0.0 AS cosine FROM e JOIN f USING (label)""")
def embedding_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector with its label's first."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    first = rows.groupBy("label").agg(F.min_by("v", "vec_id").alias("c"))

    def dot(a: str, b: str):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    return R.rounded(rows.join(first, "label").select("vec_id", (dot("v", "c") / F.sqrt(dot("v", "v") * dot("c", "c"))).alias("cosine")), 5)


@query("""SELECT event_type AS k, min(event_id) AS first_id, count(*) AS n FROM events GROUP BY 1""")
def distinct_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_type", "event_id").groupBy(F.col("event_type").alias("k")).agg(F.min("event_id").alias("first_id"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT * FROM nation WHERE n_nationkey % 4 <> 1) SELECT n_nationkey, CASE WHEN n_nationkey = 2 THEN 'fixed' ELSE n_name END AS n_name FROM r""")
def row_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    fix = spark.createDataFrame([(2, "fixed")], "n_nationkey int, value string")
    return T.repair(nation, "n_nationkey", nation.filter("n_nationkey % 4 = 1"), fix, "n_name").select("n_nationkey", "n_name")


@query("SELECT n_name AS term, CAST(n_nationkey AS DOUBLE) AS value FROM nation WHERE n_nationkey BETWEEN 1 AND 13 UNION ALL SELECT 'base', 0.0::DOUBLE")
def constant_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").filter("n_nationkey between 1 and 13").select(F.col("n_name").alias("term"), F.col("n_nationkey").cast("double").alias("value"))
    return rows.unionByName(spark.createDataFrame([("base", 0.0)], "term string, value double"))
