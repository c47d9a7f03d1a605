"""Policies and utility: worked cases and properties."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import forest, grid, overlap
from threadloom.operators import policies as P
from threadloom.operators import utility as U
from threadloom.plans import catalog
from threadloom.plans.ranking import SUBSET
from threadloom.sources.fixtures import forum_ranking

COLUMNS = "article string, comment_id string, `order` int, level int, ts long, votes_pos int, votes_neg int, votes_rel int, pred_nb double, pred_xgb double, pin_lr double, pin_xgb double, pinned boolean, x double"


def discussion(spark, features, levels=None, pinned=(), votes=None, article="a"):
    rows = []
    for k, x in enumerate(features):
        v = votes[k] if votes else 0
        rows.append((article, f"{article}{k}", k + 1, levels[k] if levels else 0, k, v, v, 0, float(v), float(v), float(v), float(v), k in pinned, float(x)))
    return forest.with_roots(spark.createDataFrame(rows, COLUMNS))


def scores(df, names, **options):
    found = U.utility(df, ("x",), P.named(*names), (10,), **options).filter("cutoff = 'N'")
    return {r.policy: r.value for r in found.collect()}


@pytest.mark.parametrize(("features", "q"), [([3, 1, 2], 0.5), ([3, 2, 1], 1.0), ([1, 2, 3], -1.0), ([2, 2, 2], 0.0)])
def test_worked_utility(spark, features, q):
    assert scores(discussion(spark, features), ["chron_rl"])["chron_rl"] == pytest.approx(q)


def test_constant_scores_may_be_left_out(spark):
    assert scores(discussion(spark, [2, 2, 2]), ["chron_rl"], on_zero="skip")["chron_rl"] is None


def test_worked_hidden_replies(spark):
    df = discussion(spark, [4, 0, 2, 2], [0, 1, 0, 1])
    assert scores(df, ["chron_rh"])["chron_rh"] == pytest.approx(2.5 / 3)
    t = U.curves(df, ("x",), P.named("chron_rh")).orderBy("i").collect()
    assert [r.t_x for r in t] == [4, 6, 7, 8] and [r.base_x for r in t] == [2, 4, 6, 8] and [r.best_x for r in t] == [4, 6, 8, 8] and [r.worst_x for r in t] == [0, 2, 4, 8]
    assert U.curves(df, ("x",), P.named("chron_rh"), interpolate=False).count() == 2


def order_of(df, name, **options):
    return [r.comment_id for r in P.positions(df, P.named(name), **options).orderBy("position").collect()]


def test_layouts_and_pinned(spark):
    df = discussion(spark, [0] * 6, [0, 1, 0, 1, 2, 0], pinned=(2,), votes=[5, 9, 1, 7, 3, 8])
    assert order_of(df, "pos-abs_rl") == ["a1", "a5", "a3", "a0", "a4", "a2"]
    assert order_of(df, "pos-abs_rh") == ["a5", "a0", "a2"]
    assert order_of(df, "pos-abs_rt") == ["a5", "a0", "a1", "a2", "a3", "a4"]
    assert order_of(df, "pos-abs_pinned_rt") == ["a2", "a3", "a4", "a5", "a0", "a1"]
    assert order_of(df, "rev-chron_rt") == ["a5", "a2", "a3", "a4", "a0", "a1"]
    assert order_of(df, "least-neg-abs_pinned_rt") == ["a2", "a3", "a4", "a0", "a1", "a5"]
    assert order_of(df, "least-neg-abs_pinned_rt", compat=True) == ["a5", "a0", "a1", "a2", "a3", "a4"]


def test_replies_without_a_root_come_last(spark):
    df = discussion(spark, [0] * 4, [1, 0, 1, 0], votes=[9, 1, 9, 2])
    assert order_of(df, "pos-abs_rt") == ["a3", "a1", "a2", "a0"]


def forum(spark):
    r = random.Random(5)
    rows = None
    for a in range(3):
        levels = [0] + [r.randint(0, 2) for _ in range(119)]
        one = discussion(spark, [r.random() for _ in levels], levels, {k for k in range(120) if r.random() < 0.05}, [r.randint(0, 9) for _ in levels], f"d{a}-")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def test_grid_properties(spark):
    df = forum(spark).cache()
    roots = {r.comment_id for r in df.filter("is_root").collect()}
    size = {r.article: r["count"] for r in df.groupBy("article").count().collect()}
    pinned = {r.comment_id for r in df.filter("pinned").collect()}
    root_of = {r.comment_id: r.root_of_tree for r in df.collect()}
    by = {}
    for r in P.positions(df, P.GRID).collect():
        by.setdefault((r.article, r.policy), []).append((r.position, r.comment_id))
    assert len(by) == 3 * 66
    for (article, policy), found in by.items():
        found.sort()
        ids = [c for _, c in found]
        assert [p for p, _ in found] == list(range(1, len(ids) + 1)) and len(set(ids)) == len(ids)
        if policy.endswith("_rh"):
            assert set(ids) <= roots
        else:
            assert len(ids) == size[article]
        if policy.endswith("_rt"):
            seen = [root_of[c] for c in ids]
            assert all(seen[k] == seen[k - 1] or seen[k] not in seen[:k] for k in range(1, len(seen)))
        if "_pinned_" in policy and not policy.endswith("_rt"):
            flags = [c in pinned for c in ids]
            assert flags == sorted(flags, reverse=True)


def test_utility_bounds(spark):
    df = forum(spark).cache()
    found = U.utility(df, ("x",), P.GRID).collect()
    assert len(found) == 3 * 66 * 4 and all(-1 - 1e-9 <= r.value <= 1 + 1e-9 for r in found)
    best = df.withColumns({"pred_nb": F.col("x"), "votes_neg": (F.col("x") * 1e6).cast("int"), "pred_xgb": -F.col("x")})
    q = scores(best, ["pred-nb_rl", "pred-xgb_rl"])
    assert q["pred-nb_rl"] == pytest.approx(1) and q["pred-xgb_rl"] == pytest.approx(-1)


def test_one_exchange_feeds_all_policies(spark, sf):
    plan = U.utility(forum_ranking(spark, sf), ("smog",), P.named(*SUBSET))._jdf.queryExecution().executedPlan().toString()
    keyed = [x.split("hashpartitioning")[1] for x in plan.split("\n") if "hashpartitioning" in x]
    assert len(keyed) == 2 and all(x.startswith("(article#") and x.split("[")[0].count("#") == 1 for x in keyed), keyed
    assert "Join" not in plan


def test_long_discussions_are_strictly_longer(spark):
    assert P.long_discussions(discussion(spark, [1.0] * 100)).count() == 0
    assert P.long_discussions(discussion(spark, [1.0] * 101)).count() == 101


def test_worked_forest(spark):
    rows = [("x", c, k + 1, lv) for k, (c, lv) in enumerate(zip("abcdef", [0, 1, 1, 2, 0, 1], strict=True))]
    df = forest.with_replies(forest.with_tree_shape(forest.with_parents(forest.with_roots(spark.createDataFrame(rows, "article string, comment_id string, `order` int, level int")))))
    got = {r.comment_id: (r.direct_root_id, r.root_of_tree, r.size_of_tree, r.height_of_tree, r.all_replies) for r in df.collect()}
    assert got == {"a": ("", "a", 4, 2, 3), "b": ("a", "a", 4, 2, 0), "c": ("a", "a", 4, 2, 0), "d": ("c", "a", 4, 2, 0), "e": ("", "e", 2, 1, 1), "f": ("e", "e", 2, 1, 0)}


def test_worked_jaccard(spark):
    rows = [("x", c, k, p, v, 0) for k, (c, p, v) in enumerate([("a", True, 1), ("b", True, 9), ("c", False, 5), ("d", False, 0)])]
    df = spark.createDataFrame(rows, "article string, comment_id string, `order` int, pinned boolean, votes_pos int, votes_neg int")
    assert overlap.preferences(df).first()["pinned|top_up"] == pytest.approx(1 / 3)


def odd_forum(spark):
    """Discussions of few rows, without roots or before the first, with nulls, NaN, ties and a root id that comes twice."""
    r = random.Random(3)

    def perhaps(value, share):
        return None if r.random() < share else value

    rows = []
    for a, n in enumerate((1, 2, 7, 12, 40, 130, 101, 9, 30)):
        root, none = None, 0.3 * (a % 2)
        for k in range(n):
            level = 1 if a == 7 or a == 6 and k == 0 else r.randint(0, 2)
            if level == 0:
                root = "8-0" if a == 8 and k > 15 else f"{a}-{k}"
            score = perhaps(r.choice([1.0, 2.0, float("nan"), 5.0]) if a == 5 else r.random(), none)
            x = None if a == 2 else perhaps(float(r.randint(-3, 9)), 0.4 * (a in (3, 5, 8)))
            rows.append((f"d{a}", f"{a}-{k}", k + 1, level, perhaps(r.randint(0, 50), none), r.randint(0, 5), perhaps(r.randint(0, 3), none), r.randint(-3, 5), score, r.random(), r.random(), r.random(), perhaps(r.random() < 0.2, none / 3), x, root, level == 0, r.random()))
    return spark.createDataFrame(rows, f"{COLUMNS}, root_of_tree string, is_root boolean, y double")


@pytest.mark.parametrize(("on_zero", "compat"), [("zero", False), ("skip", True)])
def test_arrays_score_as_windows_do(spark, monkeypatch, on_zero, compat):
    monkeypatch.setattr(grid, "CELLS", 1000)
    df = odd_forum(spark).cache()
    want, got = ({tuple(r)[:4]: r.value for r in f(df, ("x", "y"), cutoffs=(1, 10, 50), on_zero=on_zero, compat=compat).collect()} for f in (U.utility, grid.utility))
    assert want.keys() == got.keys() and {k for k, v in want.items() if v is None} == {k for k, v in got.items() if v is None}
    known = [k for k, v in want.items() if v is not None]
    assert [got[k] for k in known] == pytest.approx([want[k] for k in known], abs=1e-9)


@pytest.mark.parametrize("name", ["quartiles_by_policy_grid", "utility_full_grid", "utility_specifications"])
def test_the_grid_makes_no_row_per_policy_and_comment(spark, sf, monkeypatch, name):
    monkeypatch.setattr(P, "exploded", None)
    assert catalog.QUERIES[name](spark, sf).count() == {"quartiles_by_policy_grid": 66, "utility_full_grid": 1056, "utility_specifications": 6}[name]
