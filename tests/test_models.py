"""Models recover what data were made from; tables agree with hand-made numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import maths, sentiment, text, values
from threadloom.operators import compare, glm, metrics, relational, trees
from threadloom.sources import pages, tables


def test_expansion():
    assert glm.expand("y ~ a * b + c") == ("y", [("a",), ("b",), ("c",), ("a", "b")])
    assert glm.expand("y ~ a:b + a")[1] == [("a",), ("a", "b")]


def test_gamma_functions():
    x = np.array([0.1, 0.5, 1.0, 3.7, 20.0])
    assert glm.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329)
    assert glm.trigamma(np.array([1.0]))[0] == pytest.approx(math.pi**2 / 6)
    slope = (np.vectorize(math.lgamma)(x + 1e-5) - np.vectorize(math.lgamma)(x - 1e-5)) / 2e-5
    assert np.allclose(glm.digamma(x), slope, rtol=1e-6)


def frame(spark, **columns):
    names = list(columns)
    return spark.createDataFrame([tuple(float(v) for v in row) for row in zip(*columns.values(), strict=True)], ", ".join(f"{n} double" for n in names))


def test_logit(spark):
    r = np.random.default_rng(1)
    a, b = r.normal(size=6000), r.integers(0, 2, 6000)
    y = r.random(6000) < 1 / (1 + np.exp(-(-0.5 + 1.2 * a - 0.8 * b + 0.6 * a * b)))
    fit = glm.logit(frame(spark, y=y, a=a, b=b), "y ~ a * b")
    assert fit.names() == ["(Intercept)", "a", "b", "a:b"]
    assert all(abs(e - w) < 4 * s for e, s, w in zip(fit.estimates, fit.errors, [-0.5, 1.2, -0.8, 0.6], strict=True))
    assert fit.aic == pytest.approx(8 - 2 * fit.log_likelihood) and glm.Fit.from_json(fit.to_json()) == fit
    p = frame(spark, a=[0.0], b=[0.0]).select(fit.predicted().alias("p")).first().p
    assert p == pytest.approx(1 / (1 + math.exp(-fit.estimates[0])))


def test_negative_binomial(spark):
    r = np.random.default_rng(2)
    a = r.normal(size=6000)
    mu = np.exp(1.0 + 0.5 * a)
    y = r.poisson(mu * r.gamma(2.0, 1 / 2.0, 6000))
    fit = glm.negative_binomial(frame(spark, y=y, a=a), "y ~ a")
    assert fit.estimates == pytest.approx([1.0, 0.5], abs=0.06) and fit.extra["theta"] == pytest.approx(2.0, abs=0.25)


def test_beta(spark):
    r = np.random.default_rng(3)
    a, b = r.integers(0, 2, 8000), r.integers(0, 2, 8000)
    mu = 1 / (1 + np.exp(-(0.3 + 0.7 * a - 0.4 * b)))
    y = np.clip(r.beta(mu * 9, (1 - mu) * 9), 1e-9, 1 - 1e-9)
    rows = frame(spark, y=y, a=a, b=b)
    fit = glm.beta_regression(rows, "y ~ a + b")
    assert fit.estimates == pytest.approx([0.3, 0.7, -0.4], abs=0.05) and fit.extra["phi"] == pytest.approx(9, rel=0.06)
    table = compare.criteria(spark, {"full": fit, "less": glm.beta_regression(rows, "y ~ b")}).orderBy("bic_rank").collect()
    assert table[0].model == "full" and table[0].bic_delta == 0 and table[1].bic_delta > 0
    with pytest.raises(ValueError):
        glm.beta_regression(rows.withColumn("a", F.rand(1)), "y ~ a", most_cells=100)


def test_saved_fits_are_not_fitted_again(spark, tmp_path):
    fit = glm.Fit("logit", "y", [["a"]], [0.1, 0.2], [0.01, 0.02], -5.0, 10)
    glm.save_fits(spark, {"m": fit}, f"{tmp_path}/fits")
    saved = {k: f.to_json() for k, f in glm.load_fits(spark, f"{tmp_path}/fits").items()}
    assert glm.fitted_all({"m": lambda: pytest.fail("fitted again")}, saved) == {"m": fit}


def test_published_difference(spark):
    a = spark.createDataFrame([("t", 0.1374503, 0.0), ("u", 1.0, 1.0)], "term string, estimate double, std_error double")
    b = spark.createDataFrame([("t", 0.0436049, 0.0119902)], "term string, estimate double, std_error double")
    row = compare.difference(a, b).first()
    assert row.coef_diff == pytest.approx(0.0938454) and row.z_value == pytest.approx(7.82683, abs=2e-4) and 0 < row.p_value < 1e-13


def test_score_change_and_tail(spark):
    row = spark.createDataFrame([(0.359461626955409, 1.959964)], "x double, z double").select(maths.score_change("x").alias("c"), maths.two_sided_p("z").alias("p")).first()
    assert row.c == pytest.approx(0.177820, abs=1e-6) and row.p == pytest.approx(0.05, abs=1e-6)


def test_trees(spark):
    r = random.Random(4)
    rows = [(k, x := r.random(), r.random(), float(x > 0.6), int(20 * x)) for k in range(800)]
    df = spark.createDataFrame(rows, "key long, x double, z double, y double, votes int")
    train, test = trees.split(df, "key")
    assert train.count() + test.count() == 800 and 100 < test.count() < 220
    scored = trees.predict(trees.fit(train, ["x", "z"], "y", True, maxIter=5, maxDepth=2), test)
    assert metrics.confusion(scored, "y", "pred").first().f1 > 0.95
    counts = trees.predict(trees.fit(train, ["x", "z"], "votes", False, maxIter=8, maxDepth=4), test, False)
    assert counts.agg(maths.rmsle("votes", "pred").alias("e")).first().e < 0.3
    model, found = trees.search(train, ["x", "z"], "y", True, draws=1, folds=2)
    assert set(found) == {"maxDepth", "maxIter", "stepSize", "subsamplingRate"} and trees.predict(model, test).count() == test.count()


def test_text_rules(spark):
    rows = [(" a b", 3, 3), ("", 0, 0), (" ", 1, 1), ("a  b ", 3, 3), ("x x", 2, 1)]
    got = spark.createDataFrame(rows, "text string, n long, u long").select("text", "n", "u", text.words("text").alias("w"), text.unique_words("text").alias("v")).collect()
    assert all(r.n == r.w and r.u == r.v for r in got)
    df = spark.createDataFrame([("Hast Du das? Ja! Gut...",), ("sie kommt",), ("",)], "text string")
    out = text.with_features(df).collect()
    assert [r.second_person for r in out] == [True, False, False] and [r.num_sentences for r in out] == [3, 1, 0]
    assert out[2].smog == -2 and out[2].cttr == 0 and out[2].char_to_sent is None


def test_values(spark):
    df = spark.createDataFrame([("3. Okt. 2022, 14:05:00",), ("12. März 2021, 9:07",), ("gestern",), (None,)], "t string")
    got = [str(r[0]) for r in df.select(values.german_time("t")).collect()]
    assert got == ["2022-10-03 14:05:00", "2021-03-12 09:07:00", "None", "None"]
    out = values.filled(spark.createDataFrame([(1.0, None), (float("nan"), 2.0)], "a double, b double"), a=0.0, b=-2.0).collect()
    assert [tuple(r) for r in out] == [(1.0, -2.0), (0.0, 2.0)]


def test_sentiment_uses_the_scorer_given(spark):
    def make():
        return lambda texts: [(0.7, 0.2, 0.1) if "x" in t else (0.1, 0.2, 0.7) for t in texts]

    df = spark.createDataFrame([("x",), ("y",), (None,)], "text string")
    out = sentiment.with_sentiment(df, make=make, batch=2).collect()
    assert [(r.sentiment_class, r.sentiment_class_c) for r in out] == [("positive", 2), ("neutral", 1), ("neutral", 1)]
    assert out[0].sentiment_compound == pytest.approx(1.5)


PAGE = """<nav><a href="/inland">I</a><a href="/inland/wien">W</a></nav><h1> Title </h1><h2>Sub</h2><time datetime="2022-10-01T08:00">x</time><article><p>One <b>two</b></p><p>three</p></article>
<div class="posting pinned" id="postID:77" aria-label="Posting von anna" data-postingid="77" data-level="0"><span class="user_follower">12</span><span class="timestamp">1. Okt. 2022</span><h4 class="heading">Hi</h4><div class="text">All &amp; well</div><b class="votes_pos">5</b><b class="votes_neg">-</b></div>
<div class="posting" id="postID:78" aria-label="Posting von berta" data-level="1"></div>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None)], "page_id int, html string")
    a = {r.page_id: r for r in pages.articles(df).collect()}
    assert (a[1].title, a[1].subtitle, a[1].date, a[1].text, a[1].genre1, a[1].genre2, a[1].genre3) == ("Title", "Sub", "2022-10-01T08:00", "One two three", "/inland", "/inland/wien", None)
    assert a[2].title == "" and a[2].genre1 is None
    c = pages.comments(df, "page_id").orderBy("order").collect()
    assert [(r.order, r.comment_id, r.user_names, r.user_follower, r.level_in_tree, r.pinned, r.heading, r.text, r.votes_pos, r.votes_neg) for r in c] == [(1, "77", "anna", 12, 0, True, "Hi", "All & well", 5, 0), (2, "78", "berta", 0, 1, False, "", "", 0, 0)]
    assert df.select(pages.links("html").alias("l")).collect()[0].l == ["/inland", "/inland/wien"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted"\nline', 0.5), (2, None, None)], "k int, t string, x double")
    tables.write_csv(df, f"{tmp_path}/t")
    back = tables.read_csv(spark, f"{tmp_path}/t", "k int, t string, x double").orderBy("k").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in df.collect()]
    assert tables.read_csv(spark, f"{tmp_path}/t", "k int, t string, x double", ["k", "x"]).columns == ["k", "x"]


def test_summaries(spark, tmp_path):
    (tmp_path / "lexdiv_10.txt").write_text(" Family: beta\n      AIC       BIC    logLik -2*log(L)  df.resid \n  -100.5   -90.25    55.5   -111.0     172545 \n\nConditional model:\n             Estimate Std. Error z value Pr(>|z|)\n(Intercept)   0.50    0.10     5.0   < 2e-16 ***\npinned:a      -0.25   0.05  -5.0   1.5e-07 ***\n")
    rows = {r.term: r for r in tables.read_summaries(spark, f"file://{tmp_path}/lexdiv_10.txt").collect()}
    assert rows["(Intercept)"].estimate == 0.5 and rows["(Intercept)"].p_value == 2e-16 and rows["(Intercept)"].part == "main"
    assert rows["pinned:a"].part == "pinned" and rows["pinned:a"].aic == -100.5


def test_markup():
    out = compare.markup([{"term": "a_b", "x": 1.23456}, {"term": "c", "x": None}], ["term", "x"], "50%")
    assert r"a\_b & 1.235 \\" in out and r"c & - \\" in out and r"50\%" in out


def test_aligned_and_ranked(spark):
    a = spark.createDataFrame([("x", 1.0, 0.1), ("y", 3.0, 0.1)], "term string, estimate double, std_error double")
    b = spark.createDataFrame([("x", 2.0, 0.1)], "term string, estimate double, std_error double")
    got = {r.term: (r.full, r.part) for r in compare.aligned_coefficients({"full": a, "part": b}).collect()}
    assert got == {"x": (1.0, 2.0), "y": (3.0, None)}
    assert relational.numeric_columns(a) == ["estimate", "std_error"]


def test_feed(spark, tmp_path):
    """A stream of files gives the same features and windows as a batch."""
    from threadloom.streaming import feeds

    df = spark.createDataFrame([("a", k, f"text {k}. Du!", 1) for k in range(6)], "article string, comment_id int, text string, votes int").withColumn("time", F.timestamp_seconds(F.col("comment_id") * 400 + 1_600_000_000))
    df.write.parquet(f"{tmp_path}/feed")
    feed = feeds.read_feed(spark, f"{tmp_path}/feed", "article string, comment_id int, text string, votes int, time timestamp")
    for name, out, mode in (("f", feeds.with_features(feed), "append"), ("w", feeds.activity(feed), "complete"), ("c", feeds.first_copies(feed), "append")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("f").select("comment_id", "num_words").count() == 6 and spark.table("w").agg(F.sum("comments")).first()[0] == 6 and spark.table("c").count() == 6
