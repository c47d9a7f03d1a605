"""Queries about what surrounds the models: repaired tables, summaries in text form, stored postings, options of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import maths, text, values
from threadloom.operators import compare, glm, grid, policies, specifications, utility
from threadloom.operators import relational as R
from threadloom.plans.models import _cells, _contrasts_sql
from threadloom.plans.ranking import ONE_SQL, SUBSET, _forum, utility_sql
from threadloom.plans.registry import query
from threadloom.sources import pages, tables
from threadloom.sources.tables import table


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 > 0 THEN value END, -1.0) AS value FROM events")
def null_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events", "event_id", "value").withColumn("value", F.when(F.col("event_id") % 3 > 0, F.col("value")))
    return values.filled(rows, value=-1.0)


@query("SELECT event_id, value FROM events WHERE event_id % 3 > 0 AND value IS NOT NULL")
def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events", "event_id", "value").withColumn("value", F.when(F.col("event_id") % 3 > 0, F.col("value")))
    return R.complete_rows(rows, "value")


@query("SELECT conv_id, turn, md5(coalesce(CASE WHEN turn % 2 = 0 THEN role END, '') || ' ' || coalesce(text, '')) AS joined FROM conversations")
def joined_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading and text as one, an absent heading as empty; shown by its hash."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").withColumn("heading", F.when(F.col("turn") % 2 == 0, F.col("role")))
    return rows.select("conv_id", "turn", F.md5(text.joined("heading", "text")).alias("joined"))


@query("SELECT n_nationkey, n_regionkey FROM nation")
def columns_without_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey", "n_name")
    return R.columns_without_nulls(rows.withColumn("n_name", F.when(F.col("n_nationkey") > 3, F.col("n_name"))))


@query("SELECT o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k >= 2 AND k <= 100")
def row_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by place: all but the first, up to the hundredth."""
    return R.rows_between(table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate"), "o_orderdate", ["o_orderkey"], 2, 100).select("o_orderkey")


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS place, n_name FROM nation), b AS (SELECT row_number() OVER (ORDER BY r_regionkey) AS place, r_name FROM region)
SELECT CAST(coalesce(a.place, b.place) AS BIGINT) AS place, n_name, r_name FROM a FULL JOIN b ON a.place = b.place""")
def beside_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables side by side by place; the shorter one ends in nulls."""
    sides = [(table(spark, sf_dir, "nation"), "n_nationkey", []), (table(spark, sf_dir, "region"), "r_regionkey", [])]
    return R.beside(sides).select("place", "n_name", "r_name")


@query("""WITH m AS (SELECT event_id, CAST(event_id % 3 AS DOUBLE) AS a, CAST(event_id % 2 AS DOUBLE) AS b, 1.0::DOUBLE AS c FROM events)
SELECT event_id, 'a' AS model, a AS value, CAST(floor(1 + CAST(b < a AS INT) + CAST(c < a AS INT) + (CAST(b = a AS INT) + CAST(c = a AS INT)) / 2.0) AS INT) AS place FROM m
UNION ALL SELECT event_id, 'b', b, CAST(floor(1 + CAST(a < b AS INT) + CAST(c < b AS INT) + (CAST(a = b AS INT) + CAST(c = b AS INT)) / 2.0) AS INT) FROM m
UNION ALL SELECT event_id, 'c', c, CAST(floor(1 + CAST(a < c AS INT) + CAST(b < c AS INT) + (CAST(a = c AS INT) + CAST(b = c AS INT)) / 2.0) AS INT) FROM m""")
def row_rank_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks within rows that hold equal values: the mean of their places, cut to a whole number."""
    rows = table(spark, sf_dir, "events", "event_id").select("event_id", (F.col("event_id") % 3).cast("double").alias("a"), (F.col("event_id") % 2).cast("double").alias("b"), F.lit(1.0).alias("c"))
    return R.row_rank(rows, ["event_id"], ["a", "b", "c"])


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '-Infinity' ELSE CAST(round(ln(event_id % 4), 6) AS VARCHAR) END AS shown FROM events")
def display_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events", "event_id").withColumn("x", F.col("event_id") % 4)
    return rows.select("event_id", F.round(maths.display_log("x"), 6).cast("string").alias("shown"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS y, greatest(l_discount * 100 - 2, -1 + 1e-6) AS g FROM lineitem), d AS (SELECT *, ln(g + 1) - ln(y + 1) AS d FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, round(d / (g + 1), 5) + 0.0 AS gradient, round((1 - d) / ((g + 1) * (g + 1)) / 1e12, 8) + 0.0 AS hessian FROM d""")
def squared_log_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient and hessian (in units of 1e12) of the squared log error; guesses below -1 are lifted."""
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount").withColumn("guess", F.col("l_discount") * 100 - 2)
    found = rows.withColumn("s", maths.squared_log_gradient("l_quantity", "guess"))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", (F.round("s.gradient", 5) + 0.0).alias("gradient"), (F.round(F.col("s.hessian") / 1e12, 8) + 0.0).alias("hessian"))


_T_SQL = "(1 - 2 * exp(lgamma((f + 1) / 2) - lgamma(f / 2)) / sqrt(pi() * f) * t / 4000 / 3 * list_sum(list_transform(range(0, 4001), lambda k: CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(t * k / 4000.0, 2) / f, -(f + 1) / 2))))"


@query(f"""WITH m AS (SELECT l_linenumber AS g, l_suppkey % 19 AS k, avg(l_quantity) AS a, avg(l_extendedprice) AS b FROM lineitem GROUP BY ALL), x AS (SELECT k, sum(a) AS a, sum(b) AS b FROM m WHERE g <= 2 GROUP BY 1 HAVING count(*) = 2),
c AS (SELECT corr(a, b) AS pearson, count(*) AS n FROM x), t AS (SELECT *, n - 2.0::DOUBLE AS f, abs(pearson) * sqrt((n - 2) / (1 - pearson * pearson)) AS t FROM c)
SELECT round(pearson, 5) + 0.0 AS pearson, n, round({_T_SQL}, 5) + 0.0 AS pearson_p FROM t""")
def correlation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlation of a few means with its p-value, that of the t distribution."""
    lines = table(spark, sf_dir, "lineitem", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice").filter("l_linenumber <= 2")
    means = lines.groupBy("l_linenumber", (F.col("l_suppkey") % 19).alias("k")).agg(F.avg("l_quantity").alias("a"), F.avg("l_extendedprice").alias("b"))
    sums = means.groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("_n")).filter("_n = 2")
    return R.rounded(R.spearman(sums, "a", "b", p_values=True).select("pearson", "n", "pearson_p"), 5)


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(1 / (1 + exp(-(0.5 - 0.03 * l_quantity + 2 * l_tax + 0.4 * l_quantity * l_tax))), 6) + 0.0 AS p, round(exp(0.5 - 0.03 * l_quantity + 2 * l_tax + 0.4 * l_quantity * l_tax), 6) + 0.0 AS mu FROM lineitem")
def model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions on the response's scale of a model with an interaction, for both links."""
    _, terms = glm.expand("y ~ l_quantity * l_tax")
    fits = {name: glm.Fit(family, "y", [list(t) for t in terms], [0.5, -0.03, 2.0, 0.4], [1.0] * 4, 0.0, 1) for name, family in (("p", "logit"), ("mu", "nb2"))}
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax")
    return R.rounded(rows.select("l_orderkey", "l_linenumber", "l_partkey", *[f.predicted().alias(name) for name, f in fits.items()]))


@query(_contrasts_sql("ln(ones / zeros)", "1 / ones + 1 / zeros"))
def summary_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logit's summary written as text and parsed again."""
    summary = tables.summary_text(glm.logit(_cells(spark, sf_dir), "y ~ a * b"))
    lines = spark.createDataFrame([("logit", line) for line in summary.split("\n")], "path string, value string")
    return R.rounded(tables.model_summary(lines).select("term", "estimate", "std_error"))


@query("""WITH r AS (SELECT concat(conv_id, '-', turn) AS page, conv_id * 100 + turn AS n, turn, role, text FROM conversations)
SELECT page, CAST(1 AS INT) AS "order", concat('postID:', n) AS comment_id, CAST(n AS VARCHAR) AS id, role AS user_names, CAST(turn AS INT) AS user_follower, concat('t', turn) AS "timestamp", role AS heading, text, CASE WHEN turn = 0 THEN 'pinned' ELSE '' END AS pinned,
CAST(1 AS INT) AS is_root_comment, CAST(0 AS INT) AS is_leaf_comment, CAST(0 AS INT) AS level_in_tree, concat('postID:', n) AS root_of_tree, CAST(turn + 1 AS INT) AS votes_pos, CAST(turn AS INT) AS votes_neg FROM r
UNION ALL SELECT page, 2, concat('postID:', n, '9'), concat(n, '9'), 'none', 0, '', '', '', '', 0, 0, 1, concat('postID:', n), 0, 0 FROM r""")
def forum_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn spelled as a page with a posting and a deleted reply to it, and read back."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").withColumn("n", F.col("conv_id") * 100 + F.col("turn"))
    told = F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;")
    title = F.when(F.col("turn") == 0, F.lit("<strong><svg><title>pinned</title></svg></strong>")).otherwise(F.lit(""))
    posting = F.format_string(
        '<dst-posting class="posting posting-parent" data-level="0" aria-label="Posting von %s"><dst-posting-head class="posting--header"><dst-posting--user class="usermenu"><button><span>x</span><span><div>%d</div></span></button></dst-posting--user><time data-date="t%d">%s</time></dst-posting-head>'
        '<div class="posting--content posting--postID:%d"><h1>%s</h1><p>%s</p><p>further</p></div><dst-posting--ratinglog><button><span class="pos">%d</span><span class="neg">%d</span></button></dst-posting--ratinglog></dst-posting>',
        "role", "turn", "turn", title, "n", "role", told, F.col("turn") + 1, "turn",
    )
    deleted = F.format_string('<dst-posting class="posting posting-deleted" data-level="1" aria-label="Posting von none"><dst-posting-head><time data-date="t">x</time></dst-posting-head><div class="posting--content posting--postID:%d9"></div></dst-posting>', "n")
    page = rows.select(F.concat_ws("-", "conv_id", "turn").alias("page"), F.concat(posting, deleted).alias("html"))
    return pages.forum_comments(page, "page").withColumnRenamed("article", "page")


@query(ONE_SQL)
def utility_presorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utility with the best and worst sums and the baseline made before."""
    forum = _forum(spark, sf_dir)
    sums = utility.extremes(forum, ("lexdiv",))
    sizes = forum.groupBy("article").agg(F.avg("lexdiv").alias("mean"), F.count("*").alias("n"))
    baseline = sizes.select("article", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i"), "mean").select("article", "i", (F.col("i") * F.col("mean")).alias("base_lexdiv"))
    return R.rounded(utility.utility(forum, ("lexdiv",), policies.named("rev-chron_rl"), (10,), presorted=sums, precomputed=baseline))


@query(f"""PIVOT (SELECT article, policy, value FROM ({utility_sql(SUBSET, ("lexdiv",), ("N",))})) ON policy IN ({', '.join(f"'{p}'" for p in SUBSET)}) USING first(value) GROUP BY article""")
def score_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of one feature and cut-off as a table of discussions by policies, through the long form and back."""
    grid = policies.named(*SUBSET)
    wide = utility.matrix(R.rounded(utility.utility(_forum(spark, sf_dir), ("lexdiv",), grid, ())), "lexdiv", "N", grid)
    return utility.matrix(utility.from_matrix(wide, "lexdiv", "N"), "lexdiv", "N", grid)


@query()
def utility_specifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six beta regressions of the scores of all policies, with AIC and BIC."""
    scores = grid.utility(_forum(spark, sf_dir), ("lexdiv",), policies.GRID, ()).select(F.col("policy").alias("policy_name"), maths.squeeze("value").alias("utility"))
    named = policies.parse_name(scores)
    levels = [x.removeprefix("policy_") for x in specifications.POLICIES]
    # six fits read the same scores, which are made once
    rows = R.dummies(R.dummies(named, "policy", levels), "replies", ["rh", "rt"]).persist()
    try:
        return compare.criteria(spark, {name: glm.beta_regression(rows, formula) for name, formula in specifications.utility_models().items()})
    finally:
        rows.unpersist()
