"""Queries about models, their metrics and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import maths
from threadloom.operators import compare, glm, metrics, trees
from threadloom.operators.relational import rounded
from threadloom.plans.registry import query
from threadloom.sources.fixtures import labelled
from threadloom.sources.tables import table

SCORED_SQL = "scored AS (SELECT quality, (n_chars % 97) / 97.0::DOUBLE AS score, lang FROM documents JOIN labels USING (doc_id))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("quality", ((F.col("n_chars") % 97) / 97.0).alias("score"), "lang")


@query(f"""WITH {SCORED_SQL}, c AS (SELECT lang, count(*) FILTER (quality = 1 AND score >= 0.5) AS tp, count(*) FILTER (quality <> 1 AND score >= 0.5) AS fp, count(*) FILTER (quality = 1 AND score < 0.5) AS fn, count(*) FILTER (quality <> 1 AND score < 0.5) AS tn FROM scored GROUP BY lang)
SELECT *, round(tp / nullif(tp + fp, 0), 6) + 0.0 AS "precision", round(tp / nullif(tp + fn, 0), 6) + 0.0 AS recall, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) + 0.0 AS accuracy, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) + 0.0 AS f1 FROM c""")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.confusion(_scored(spark, sf_dir), "quality", "score", 0.5, "lang"))


PR_SQL = f"""WITH {SCORED_SQL}, p AS (SELECT score, count(*) FILTER (quality = 1) AS pos, count(*) AS n FROM scored GROUP BY score),
s AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS said, sum(pos) OVER () AS total FROM p), c AS (SELECT score, tp / total AS recall, tp / said AS precision FROM s)"""


@query(f'{PR_SQL} SELECT round(score, 6) + 0.0 AS score, round(recall, 6) + 0.0 AS recall, round("precision", 6) + 0.0 AS "precision" FROM c')
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.pr_curve(_scored(spark, sf_dir), "quality", "score"))


@query(f'{PR_SQL} SELECT round(sum(dx * m), 6) + 0.0 AS area FROM (SELECT recall - lag(recall) OVER w AS dx, ("precision" + lag("precision") OVER w) / 2 AS m FROM c WINDOW w AS (ORDER BY score DESC))')
def auc_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.pr_auc(_scored(spark, sf_dir), "quality", "score"))


@query("SELECT l_returnflag, round(sqrt(avg(pow(ln(greatest(l_extendedprice * l_discount / 100 - 5, 0) + 1) - ln(l_quantity + 1), 2))), 5) + 0.0 AS rmsle FROM lineitem GROUP BY 1")
def rmsle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount").withColumn("guess", F.col("l_extendedprice") * F.col("l_discount") / 100 - 5)
    return rounded(rows.groupBy("l_returnflag").agg(maths.rmsle("l_quantity", "guess").alias("rmsle")), 5)


def _means(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", "l_suppkey", column)
    return rows.groupBy(F.concat(F.lit("s"), "l_suppkey").alias("term")).agg(maths.exact_mean(column).alias("estimate"), (F.stddev_samp(column) / F.sqrt(F.count("*"))).alias("std_error"))


def _diff_sql(a: str, b: str) -> str:
    return f"""SELECT term, a.e AS coef_model1, b.e AS coef_model2, a.e - b.e AS coef_diff, sqrt(a.s * a.s + b.s * b.s) AS se_diff FROM {a} a JOIN {b} b USING (term)"""


MEANS_SQL = """WITH q AS (SELECT concat('s', l_suppkey) AS term, avg(l_quantity) AS e, stddev_samp(l_quantity) / sqrt(count(*)) AS s FROM lineitem GROUP BY 1),
d AS (SELECT concat('s', l_suppkey) AS term, avg(l_discount) AS e, stddev_samp(l_discount) / sqrt(count(*)) AS s FROM lineitem GROUP BY 1), t AS (SELECT concat('s', l_suppkey) AS term, avg(l_tax) AS e, stddev_samp(l_tax) / sqrt(count(*)) AS s FROM lineitem GROUP BY 1)"""
#: The tail of the normal density beyond |z|, by Simpson's rule over 8 standard deviations.
P_SQL = """CAST(round(2 * exp(-z * z / 2) / sqrt(2 * pi()) * 8.0 / 2000 / 3 * list_sum(list_transform(range(0, 2001), lambda k: CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-abs(z) * k / 250.0 - k * k / 125000.0))), 9) + 0.0 AS DOUBLE)"""
DIFF_COLUMNS = """term, round(coef_model1, 5) + 0.0 AS coef_model1, round(coef_model2, 5) + 0.0 AS coef_model2, round(coef_diff, 5) + 0.0 AS coef_diff, round(se_diff, 5) + 0.0 AS se_diff, round(coef_diff / se_diff, 4) + 0.0 AS z_value,
round(coef_diff - 1.96 * se_diff, 5) + 0.0 AS ci_lower_95, round(coef_diff + 1.96 * se_diff, 5) + 0.0 AS ci_upper_95, round(coef_diff - 2.576 * se_diff, 5) + 0.0 AS ci_lower_99, round(coef_diff + 2.576 * se_diff, 5) + 0.0 AS ci_upper_99"""
TESTED_COLUMNS = f"""{DIFF_COLUMNS}, {P_SQL} AS p_value"""


def _five(df: DataFrame, *keep: str) -> DataFrame:
    out = rounded(df.withColumn("z_value", F.round("z_value", 4)).withColumns({f"_{c}": F.struct(c) for c in keep}), 5)
    return out.withColumns({c: F.col(f"_{c}.{c}") for c in keep}).drop(*[f"_{c}" for c in keep])


@query(f"{MEANS_SQL}, x AS ({_diff_sql('q', 'd')}) SELECT {DIFF_COLUMNS} FROM x")
def coef_diff_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _five(compare.difference(_means(spark, sf_dir, "l_quantity"), _means(spark, sf_dir, "l_discount"), False))


@query(f"{MEANS_SQL}, v AS (SELECT term, coef_diff AS e, se_diff AS s FROM ({_diff_sql('d', 't')})), x AS ({_diff_sql('q', 'v')}) SELECT {DIFF_COLUMNS} FROM x")
def compound_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _five(compare.compound(_means(spark, sf_dir, "l_quantity"), _means(spark, sf_dir, "l_discount"), _means(spark, sf_dir, "l_tax"), False))


@query(f"{MEANS_SQL}, x AS ({_diff_sql('q', 'd')}), y AS (SELECT *, coef_diff / se_diff AS z FROM x) SELECT {TESTED_COLUMNS} FROM y")
def coef_diff_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences with their p-values."""
    return _tested(compare.difference(_means(spark, sf_dir, "l_quantity"), _means(spark, sf_dir, "l_discount")))


@query(f"{MEANS_SQL}, v AS (SELECT term, coef_diff AS e, se_diff AS s FROM ({_diff_sql('d', 't')})), x AS (SELECT term, coef_model1 - 25.3 AS coef_model1, coef_model2, coef_diff - 25.3 AS coef_diff, se_diff FROM ({_diff_sql('q', 'v')})), y AS (SELECT *, coef_diff / se_diff AS z FROM x) SELECT {TESTED_COLUMNS} FROM y")
def compound_diff_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compound differences of centred means, so that p-values of all sizes occur."""
    centred = _means(spark, sf_dir, "l_quantity").withColumn("estimate", F.col("estimate") - 25.3)
    return _tested(compare.compound(centred, _means(spark, sf_dir, "l_discount"), _means(spark, sf_dir, "l_tax")))


def _tested(df: DataFrame) -> DataFrame:
    return _five(df.withColumn("_p", F.round("p_value", 9) + 0.0).drop("p_value").withColumnRenamed("_p", "p_value").select(*[c for c in df.columns]), "p_value")


@query(f"""{MEANS_SQL}, a AS (SELECT row_number() OVER (ORDER BY e DESC, term) AS place, term, round(e, 3) AS v FROM q), b AS (SELECT row_number() OVER (ORDER BY e DESC, term) AS place, term, round(e, 3) AS v FROM d)
SELECT CAST(a.place AS INT) AS place, a.term AS up_term, a.v AS up_value, b.term AS down_term, b.v AS down_value FROM a JOIN b USING (place)""")
def genre_ranking_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.side_by_side_ranking({"up": _means(spark, sf_dir, "l_quantity"), "down": _means(spark, sf_dir, "l_discount")})


@query("""WITH e AS (SELECT CASE WHEN event_type = 'click' THEN 'main' ELSE event_type END AS policy, CASE WHEN user_id % 2 = 0 THEN 'rh' ELSE 'rt' END AS interaction, CASE WHEN event_id % 2 = 0 THEN 'x' ELSE 'y' END AS variable, avg(value) AS estimate FROM events GROUP BY ALL)
SELECT a.policy, interaction, variable, round(a.estimate, 5) + 0.0 AS estimate, round(a.estimate + m.estimate, 5) + 0.0 AS total FROM e a JOIN e m USING (interaction, variable) WHERE a.policy <> 'main' AND m.policy = 'main'""")
def interaction_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events", "event_type", "user_id", "event_id", "value")
    cells = rows.groupBy(F.when(F.col("event_type") == "click", "main").otherwise(F.col("event_type")).alias("policy"), F.when(F.col("user_id") % 2 == 0, "rh").otherwise("rt").alias("interaction"), F.when(F.col("event_id") % 2 == 0, "x").otherwise("y").alias("variable")).agg(F.avg("value").alias("estimate"))
    return rounded(compare.interaction_sums(cells).select("policy", "interaction", "variable", "estimate", "total"), 5)


@query("""WITH e AS (SELECT event_id, event_type = 'click' AS is_root, (event_id % 91 + 1) / 100.0::DOUBLE AS p FROM events), m AS (SELECT min(p) AS m FROM e WHERE is_root) SELECT event_id, round(CASE WHEN is_root THEN p ELSE p * m END, 6) + 0.0 AS p FROM e, m""")
def damped_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events", "event_id", "event_type").select("event_id", (F.col("event_type") == "click").alias("is_root"), ((F.col("event_id") % 91 + 1) / 100.0).alias("p"))
    return rounded(glm.damped(rows, "p").select("event_id", "p"))


@query("SELECT event_id, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 5 = 0 AS test FROM events")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = trees.split(table(spark, sf_dir, "events", "event_id"), "event_id")
    return train.withColumn("test", F.lit(False)).unionByName(test.withColumn("test", F.lit(True)))


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", "l_quantity", "l_tax", "l_discount", "l_returnflag", "l_linenumber")
    return rows.select(F.col("l_quantity").alias("votes"), (F.col("l_tax") * 10).alias("tax"), (F.col("l_discount") * 10).alias("discount"), (F.col("l_returnflag") == "R").cast("int").alias("returned"), (F.col("l_linenumber") == 1).cast("int").alias("first"))


CELLS_SQL = """WITH rows AS (SELECT CAST(l_returnflag = 'R' AS INT) AS y, CAST(l_linenumber = 1 AS INT) AS a, CAST(l_quantity > 25 AS INT) AS b, l_quantity AS votes FROM lineitem),
c AS (SELECT a, b, sum(y)::DOUBLE AS ones, (count(*) - sum(y))::DOUBLE AS zeros, avg(votes) AS mean FROM rows GROUP BY ALL)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", "l_quantity", "l_returnflag", "l_linenumber")
    return rows.select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_linenumber") == 1).cast("int").alias("a"), (F.col("l_quantity") > 25).cast("int").alias("b"), F.col("l_quantity").alias("votes"))


def _contrasts_sql(value: str, variance: str | None) -> str:
    """Coefficients of a saturated model over two dummies, as contrasts of a value of its four cells."""
    cells = {f"v{a}{b}": f"max({value}) FILTER (a = {a} AND b = {b})" for a in (0, 1) for b in (0, 1)}
    errors = {f"s{a}{b}": f"max({variance}) FILTER (a = {a} AND b = {b})" for a in (0, 1) for b in (0, 1)} if variance else {}
    wide = ", ".join(f"{x} AS {n}" for n, x in (cells | errors).items())
    terms = (("(Intercept)", "v00", "s00"), ("a", "v10 - v00", "s10 + s00"), ("b", "v01 - v00", "s01 + s00"), ("a:b", "v11 - v10 - v01 + v00", "s11 + s10 + s01 + s00"))
    picked = " UNION ALL ".join(f"SELECT '{t}' AS term, round({e}, 6) + 0.0 AS estimate" + (f", round(sqrt({s}), 6) + 0.0 AS std_error" if variance else "") + " FROM w" for t, e, s in terms)
    return f"{CELLS_SQL}, w AS (SELECT {wide} FROM c) {picked}"


@query(_contrasts_sql("ln(ones / zeros)", "1 / ones + 1 / zeros"))
def logit_saturated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logit over all combinations of two dummies: its estimates are contrasts of the cells' log odds."""
    return rounded(glm.logit(_cells(spark, sf_dir), "y ~ a * b").tidy(spark).select("term", "estimate", "std_error"))


@query(_contrasts_sql("ln(mean)", None))
def negative_binomial_saturated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NB2 over all combinations of two dummies: whatever theta is, its estimates are contrasts of the cells' log means."""
    return rounded(glm.negative_binomial(_cells(spark, sf_dir), "votes ~ a * b", rounds=8).tidy(spark).select("term", "estimate"))


def _nested_sql(*by: str) -> str:
    group = f"GROUP BY {', '.join(by)}" if by else ""
    return f"SELECT sum(o * ln(o / (o + z)) + z * ln(z / (o + z))) AS ll, sum(o + z) AS n FROM (SELECT sum(ones) AS o, sum(zeros) AS z FROM c {group})"


@query(f"""{CELLS_SQL}, m AS (SELECT 'empty' AS model, 1 AS k, * FROM ({_nested_sql()}) UNION ALL SELECT 'one', 2, * FROM ({_nested_sql('a')}) UNION ALL SELECT 'both', 4, * FROM ({_nested_sql('a', 'b')})),
t AS (SELECT model, CAST(k AS INT) AS k, CAST(n AS BIGINT) AS n, ll, 2 * k - 2 * ll AS aic, k * ln(n) - 2 * ll AS bic FROM m)
SELECT model, k, n, round(ll, 4) + 0.0 AS log_lik, round(aic, 4) + 0.0 AS aic, round(bic, 4) + 0.0 AS bic, CAST(rank() OVER (ORDER BY bic) AS INT) AS bic_rank, round(bic - min(bic) OVER (), 4) + 0.0 AS bic_delta FROM t""")
def nested_logit_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nested logits with AIC and BIC; each is saturated in what it has, so that its likelihood is that of its cells."""
    rows = _cells(spark, sf_dir)
    return rounded(compare.criteria(spark, {"empty": glm.logit(rows, "y ~ 1"), "one": glm.logit(rows, "y ~ a"), "both": glm.logit(rows, "y ~ a * b")}), 4)


@query(f"""{MEANS_SQL}, small AS (SELECT * FROM d WHERE term LIKE '%1%'), most AS (SELECT * FROM t WHERE term NOT LIKE '%7%' OR term = 's7') SELECT term, round(q.e, 5) + 0.0 AS whole, round(small.e, 5) + 0.0 AS small, round(most.e, 5) + 0.0 AS most FROM q LEFT JOIN small USING (term) LEFT JOIN most USING (term)""")
def aligned_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates of smaller models beside those of the one with the most terms."""
    small = _means(spark, sf_dir, "l_discount").filter("term like '%1%'")
    most = _means(spark, sf_dir, "l_tax").filter("term not like '%7%' or term = 's7'")
    return rounded(compare.aligned_coefficients({"whole": _means(spark, sf_dir, "l_quantity"), "small": small, "most": most}), 5)


@query()
def logit_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glm.logit(_votes(spark, sf_dir), "returned ~ tax + discount * first").tidy(spark)


@query()
def negative_binomial_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glm.negative_binomial(_votes(spark, sf_dir), "votes ~ tax + first", rounds=8).tidy(spark)


@query()
def beta_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _votes(spark, sf_dir).withColumn("share", F.least(F.greatest(F.col("votes") / 51, F.lit(1e-6)), F.lit(1 - 1e-6)))
    fits = {"additive": glm.beta_regression(rows, "share ~ returned + first"), "interaction": glm.beta_regression(rows, "share ~ returned * first")}
    return compare.criteria(spark, fits)


@query()
def boosted_trees_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    rows = lines.select("key", F.col("l_quantity").alias("votes"), (F.col("l_tax") * 10).alias("tax"), (F.col("l_discount") * 10).alias("discount"), (F.col("l_returnflag") == "R").cast("int").alias("returned"))
    train, test = trees.split(rows, "key")
    model = trees.fit(train, ["votes", "tax", "discount"], "returned", True, maxIter=5, maxDepth=3)
    return metrics.confusion(trees.predict(model, test), "returned", "pred")
