"""Options, summaries, stored postings and columns at their edges."""

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from threadloom.functions import maths, text
from threadloom.operators import glm, metrics, relational, specifications, utility
from threadloom.operators import policies as P
from threadloom.plans import catalog
from threadloom.sources import fixtures, pages, tables


def test_summaries_are_read_as_written(spark, tmp_path):
    fits = {n: glm.Fit("beta", "y", [["a"], ["replies_rh", "a"]], [0.5, -1.25, 1e-7 + k], [0.1, 0.02, 0.3], 123.5, 900, {"phi": 21.5 + k}) for k, n in enumerate(("smog_10", "smog_N"))}
    tables.write_summaries(spark, fits, f"{tmp_path}/s")
    rows = tables.read_summaries(spark, f"{tmp_path}/s").collect()
    assert len(rows) == 6
    for k, (name, fit) in enumerate(fits.items()):
        own = {r.term: r for r in rows if f"name={name}/" in r.path}
        assert [own[t].estimate for t in fit.names()] == pytest.approx(fit.estimates)
        assert own["a"].aic == pytest.approx(fit.aic) and own["a"].bic == pytest.approx(fit.bic, abs=1e-5) and own["a"].dispersion == 21.5 + k
    none = spark.createDataFrame([("p", "no model")], "path string, value string")
    assert tables.model_summary(none).count() == 0


def test_csv_with_row_names(spark, tmp_path):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, None)], "k int, t string")
    tables.write_csv(df, f"{tmp_path}/t", row_names="k")
    back = spark.read.option("header", True).csv(f"{tmp_path}/t").orderBy("_row").collect()
    assert [(r._row, r.k) for r in back] == [("1", "1"), ("2", "2"), ("3", "3")]
    assert sorted(r.k for r in tables.read_csv(spark, f"{tmp_path}/t", "k int, t string", row_names=True).collect()) == [1, 2, 3]


def test_scores_out_and_in_again(spark, tmp_path):
    rows = [(a, p, "smog", c, a + len(p) / 10) for a in (1, 2) for p in ("chron_rl", "chron_rh") for c in ("10", "50", "N")][:-1]
    scores = spark.createDataFrame(rows, "article long, policy string, feature string, cutoff string, value double")
    utility.export(scores, f"{tmp_path}/scores")
    got = sorted(map(tuple, utility.ingest(spark, f"{tmp_path}/scores").collect()))
    assert got == sorted(r for r in rows if r[3] != "50")
    wide = utility.matrix(scores, "smog", "N", P.named("chron_rl", "chron_rh"))
    assert {r.article: r.chron_rh for r in wide.collect()} == {1: 1.8, 2: None}
    assert utility.from_matrix(wide, "smog", "N").count() == 3


def test_demo_orders(spark):
    rows = fixtures.demo_orders(spark, 50, 2.0, 3.0).collect()
    by = {a: [r.x for r in sorted(rows, key=lambda r: r.order) if r.article == a] for a in ("sorted", "half", "shuffled", "reversed")}
    assert by["sorted"] == sorted(by["sorted"], reverse=True) == by["reversed"][::-1]
    assert all(sorted(v) == by["reversed"] for v in by.values()) and by["half"][1::2] == by["sorted"][1::2] and by["half"] != by["sorted"]
    forum = fixtures.demo_orders(spark, 50).select("article", "order", "x", F.lit(True).alias("is_root"))
    ends = {(r.article, r.i): (r.best_x, r.worst_x) for r in utility.extremes(forum, ("x",)).groupBy("article", "i").agg(F.max("best_x").alias("best_x"), F.max("worst_x").alias("worst_x")).collect()}
    assert ends["sorted", 50] == pytest.approx(ends["reversed", 50]) and ends["half", 1][0] > ends["half", 1][1]


def test_correlation_p_against_permutations_of_angles(spark):
    # a correlation of n rows at random is the cosine of an angle on the sphere of n - 1 dimensions
    r = np.random.default_rng(4)
    for n, c in ((3, 0.6), (5, -0.4), (12, 0.55), (40, 0.2)):
        points = r.normal(size=(400_000, n - 1))
        share = np.mean(np.abs(points[:, 0]) / np.linalg.norm(points, axis=1) >= abs(c))
        got = spark.range(1).select(F.lit(c).alias("r"), F.lit(n).alias("n")).select(maths.correlation_p("r", "n").alias("p")).first().p
        assert got == pytest.approx(share, abs=0.004)
    edge = spark.createDataFrame([(1.0, 5), (0.0, 5), (0.5, 2), (None, 9), (0.05, 10_000), (0.05, 10_001)], "r double, n long").select(maths.correlation_p("r", "n").alias("p")).collect()
    assert edge[0].p == 0 and edge[1].p == pytest.approx(1) and edge[2].p is None and edge[3].p is None
    assert edge[4].p == pytest.approx(edge[5].p, rel=0.01)


def test_percentiles_with_nulls_ties_and_hot_groups(spark):
    r = np.random.default_rng(5)
    rows = [("hot", float(v)) for v in r.integers(0, 900, 3000)] + [("one", 2.5), ("none", None), (None, 1.0), (None, 4.0), ("hot", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {x.g: (x.q25, x.median, x.q75) for x in relational.quartiles(df, "x", "g").collect()}
    hot = [v for g, v in rows if g == "hot" and v is not None]
    assert got["hot"] == pytest.approx(tuple(np.quantile(hot, [0.25, 0.5, 0.75])))
    assert got["one"] == (2.5, 2.5, 2.5) and got["none"] == (None, None, None) and got[None] == (1.75, 2.5, 3.25)


def test_running_sums_of_an_empty_table_and_pr_of_one_score(spark):
    df = spark.createDataFrame([], "k double, v long")
    assert relational.running_sums(df, "k", ["v"]).count() == 0
    one = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, s double")
    assert metrics.pr_auc(one, "y", "s").first().area is None
    assert [tuple(r) for r in metrics.pr_curve(one, "y", "s").collect()] == [(0.5, 1.0, 0.5)]


def test_areas_know_the_direction(spark):
    df = spark.createDataFrame([(g, k, float(x), float(y)) for g, xs in (("up", (0, 1, 3)), ("down", (3, 1, 0)), ("both", (0, 2, 1))) for k, (x, y) in enumerate(zip(xs, (1, 3, 3), strict=True))], "g string, _at int, x double, y double")
    assert {r.g: r.area for r in maths.trapezoid(df, "x", "y", "g").collect()} == {"up": 8.0, "down": 7.0, "both": None}


def test_tokens_and_long_words(spark):
    texts = ["Der Derwisch und die Diebe", "", None, "aber", "Umundum um umund", "größer Äpfel ßtraße der-die"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.k for r in df.select(text.tokens("t").alias("k")).collect()]
    assert got == [["derwisch", "diebe"], [], None, [], ["umundum", "umund"], ["größer", "äpfel", "ßtraße"]]
    long = [r.n for r in spark.createDataFrame([("Banane an anana Autobahn xyz Ei Kaffeehaus",), ("",)], "t string").select(text.polysyllables("t").alias("n")).collect()]
    assert long == [4, 0]


def test_display_log(spark):
    got = [r.x for r in spark.createDataFrame([(0.0,), (1.0,), (-1.0,), (None,)], "v double").select(maths.display_log("v").alias("x")).collect()]
    assert got[0] == -math.inf and got[1] == 0 and math.isnan(got[2]) and got[3] is None


def test_pages_without_postings(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<h1>x</h1><p>y"), (4, '<dst-posting class="posting" aria-label="" data-level="x"><p>out</p>')], "k int, html string")
    rows = pages.forum_comments(df, "k").collect()
    assert len(rows) == 1 and rows[0].article == 4 and rows[0].text == "" and rows[0].is_leaf_comment == 1 and rows[0].is_root_comment == 1


def test_formulas_with_brackets():
    assert glm.expand("y ~ (a + b) * (c + d)")[1] == [("a",), ("b",), ("c",), ("d",), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d")]
    assert glm.expand("y ~ (a + b):c + 1")[1] == [("a", "c"), ("b", "c")]
    assert glm.expand("y ~ x-1 * p:q")[1] == [("x-1",), ("p", "q"), ("p", "q", "x-1")]
    for wrong in ("y ~ (a + b", "y ~ a)"):
        with pytest.raises(ValueError):
            glm.expand(wrong)


def test_sizes_of_the_specifications():
    """Coefficients and a dispersion where there is one, with the 14 dummies of the published genres."""
    genres = [f"genre1_{k}" for k in range(14)]
    sizes = lambda models, more: [1 + more + len(glm.expand(f)[1]) for f in models.values()]
    assert sizes(specifications.pick_models(genres), 0) == [28, 32, 34]
    assert sizes(specifications.vote_models(genres), 1) == [31, 32, 36, 37] == sizes(specifications.vote_models(genres, "votes_neg"), 1)
    assert sizes(specifications.utility_models(), 1) == [15, 35, 25, 45, 47, 67]
    assert glm.expand(specifications.vote_models(genres, "votes_neg")["votes_neg_4"])[1][-1] == ("votes_pos_log",)


def test_nested_utilities_fit_better_with_more_terms(spark, sf):
    rows = {r.model: r for r in catalog.QUERIES["utility_specifications"](spark, sf).collect()}
    assert [rows[f"utility_{k}"].k for k in range(1, 7)] == [15, 35, 25, 45, 47, 67]
    for less, more in ((1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 6)):
        assert rows[f"utility_{less}"].log_lik <= rows[f"utility_{more}"].log_lik + 1e-6


def test_three_decimals_round_as_c_does(spark):
    r = np.random.default_rng(4)
    ties = [(k + 0.5) / 1000 for k in r.integers(0, 10**9, 300).tolist()]
    numbers = [2.0625, -2.0625, 25.5625, 0.0, -0.0, -0.0001, 0.9995, 1e15 + 0.0625, 1e-300, *ties, *[math.nextafter(t, 0) for t in ties], *[k / 640 for k in range(16000, 16640)]]
    rows = spark.createDataFrame([(float(x),) for x in numbers], "x double").select("x", text.three_decimals(F.col("x")).alias("shown")).collect()
    assert [q.shown for q in rows] == ["%.3f" % q.x for q in rows]
    odd = spark.createDataFrame([(None,), (math.nan,)], "x double").select(text.three_decimals(F.col("x")).alias("shown")).collect()
    assert [q.shown for q in odd] == ["-", "-"]


def copies(tmp_path):
    """Lines of twelve suppliers whose values are the same in other orders, beside some whose aren't."""
    r = np.random.default_rng(6)
    value, price = r.integers(0, 11, 97) / 100, r.integers(100, 10**7, 97) / 100
    rows = []
    for k in range(24):
        kept = r.permutation(97) if k < 12 else np.sort(r.choice(97, 60, replace=False))
        rows += [(k, float(i % 50 + (k >= 12) * k), value[i], price[i]) for i in kept]
    supplier, quantity, discount, cost = zip(*rows, strict=True)
    pq.write_table(pa.table({"l_suppkey": pa.array(supplier, pa.int64()), "l_quantity": quantity, "l_discount": discount, "l_extendedprice": cost}), tmp_path / "lineitem.parquet")
    return rows


def test_equal_means_are_ranked_by_name(spark, tmp_path):
    copies(tmp_path)
    rows = catalog.QUERIES["genre_ranking_table"](spark, str(tmp_path)).orderBy("place").collect()
    same = [f"s{k}" for k in range(12)]
    assert [q.down_term for q in rows if q.down_term in same] == sorted(same)
    assert [q.up_term for q in rows if q.up_term in same] == sorted(same)


def test_equal_means_share_their_rank(spark, tmp_path):
    rows = copies(tmp_path)
    by = {}
    for k, quantity, _, cost in rows:
        by.setdefault(k, []).append((Fraction(quantity), Fraction(str(cost))))
    means = [[sum(side) / len(v) for side in zip(*v, strict=True)] for v in by.values()]
    a, b = ([sum(y < x for y in side) + (sum(y == x for y in side) + 1) / 2 for x in side] for side in zip(*means, strict=True))
    found = catalog.QUERIES["spearman"](spark, str(tmp_path)).first()
    assert found.spearman == pytest.approx(np.corrcoef(a, b)[0, 1], abs=6e-6) and found.n == 24


def test_exact_means_and_what_has_none(spark):
    rows = [("a", 0.1), ("a", 0.2), ("a", 0.3), ("a", None), ("b", 1e12), ("b", 0.5), ("c", math.nan), ("c", 1.0), ("d", None), ("e", 1 / 3)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: r.m for r in df.groupBy("k").agg(maths.exact_mean("x").alias("m")).collect()}
    assert got["a"] == 0.2 and got["b"] == (1e12 + 0.5) / 2 and math.isnan(got["c"]) and got["d"] is None and got["e"] == 1 / 3
