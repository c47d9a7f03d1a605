"""Queries about ranking policies and their utility."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import grid
from threadloom.operators import policies as P
from threadloom.operators import utility as U
from threadloom.operators.relational import dummies, melt, quartiles, rounded
from threadloom.plans.registry import query
from threadloom.sources.fixtures import FEATURES, FORUM_SQL, forum_ranking

#: Policies of the queries that aren't about the whole grid.
SUBSET = ("rev-chron_pinned_rt", "chron_rl", "pos-abs_pinned_rl", "least-neg-abs_rt", "pred-nb_rh", "random_pinned_rh")

KEYS_SQL = """
drawn AS (
  SELECT *, CAST(CAST('0x' || substr(md5(comment_id || '-7'), 1, 13) AS BIGINT) AS DOUBLE) AS random, count(*) OVER (PARTITION BY article) AS n,
         sum(CASE WHEN is_root THEN 1 ELSE 0 END) OVER (PARTITION BY article) AS n_roots
  FROM forum
), tree AS (
  SELECT c.*, r.ts AS r_ts, r.votes_neg AS r_neg, r.pinned AS r_pinned FROM drawn c JOIN drawn r ON c.article = r.article AND c.root_ord = r.ord
), keyed AS (
  SELECT *, 'rev-chron_pinned_rt' AS policy, CASE WHEN r_pinned THEN 0 ELSE 1 END AS k0, CASE WHEN r_pinned THEN root_ord END AS k1, CASE WHEN r_pinned THEN NULL ELSE -r_ts END AS k2, -root_ord AS k3 FROM tree
  UNION ALL SELECT *, 'chron_rl', 0, NULL, ts, ord FROM tree
  UNION ALL SELECT *, 'pos-abs_pinned_rl', CASE WHEN pinned THEN 0 ELSE 1 END, CASE WHEN pinned THEN ord END, CASE WHEN pinned THEN NULL ELSE -votes_pos END, ord FROM tree
  UNION ALL SELECT *, 'least-neg-abs_rt', 0, NULL, r_neg, -root_ord FROM tree
  UNION ALL SELECT *, 'pred-nb_rh', 0, NULL, -pred_nb, ord FROM tree WHERE is_root
  UNION ALL SELECT *, 'random_pinned_rh', CASE WHEN pinned THEN 0 ELSE 1 END, CASE WHEN pinned THEN ord END, CASE WHEN pinned THEN NULL ELSE random END, ord FROM tree WHERE is_root
), ranked AS (
  SELECT *, row_number() OVER w AS i FROM keyed WINDOW w AS (PARTITION BY article, policy ORDER BY k0 NULLS LAST, k1 NULLS LAST, k2 NULLS LAST, k3 NULLS LAST, ord)
)
"""


def curve_sql(features: tuple[str, ...]) -> str:
    """Running sums, interpolated, with best, worst and base, of some features."""
    cum = ", ".join(f"sum({f}) OVER (PARTITION BY article, policy ORDER BY i ROWS UNBOUNDED PRECEDING) AS t_{f}, sum({f}) OVER (PARTITION BY article, policy) AS part_{f}" for f in features)
    tot = ", ".join(f"sum({f}) AS total_{f}" for f in features)
    ends = ", ".join(
        f"sum({f}) OVER (PARTITION BY article ORDER BY {f} DESC, ord ROWS UNBOUNDED PRECEDING) AS best_{f}, row_number() OVER (PARTITION BY article ORDER BY {f} DESC, ord) AS bi_{f}, "
        f"sum({f}) OVER (PARTITION BY article ORDER BY {f}, ord ROWS UNBOUNDED PRECEDING) AS worst_{f}, row_number() OVER (PARTITION BY article ORDER BY {f}, ord) AS wi_{f}"
        for f in features
    )
    joins = " ".join(f"JOIN ends b_{f} ON b_{f}.article = e.article AND b_{f}.bi_{f} = e.i JOIN ends w_{f} ON w_{f}.article = e.article AND w_{f}.wi_{f} = e.i" for f in features)
    far = ", ".join(f"CASE WHEN k.policy LIKE '%\\_rh' ESCAPE '\\' AND g.i > k.n_roots THEN k.part_{f} + (t.total_{f} - k.part_{f}) / (k.n - k.n_roots) * (g.i - k.n_roots) ELSE k.t_{f} END AS t_{f}, t.total_{f}" for f in features)
    picked = ", ".join(f"e.t_{f}, e.total_{f}, b_{f}.best_{f}, w_{f}.worst_{f}, e.i * e.total_{f} / e.n AS base_{f}" for f in features)
    return f"""
, summed AS (SELECT *, {cum} FROM ranked)
, totals AS (SELECT article, {tot} FROM forum GROUP BY article)
, ends AS (SELECT article, {ends} FROM forum)
, steps AS (
  SELECT article, policy, n, n_roots, unnest(CASE WHEN policy LIKE '%\\_rh' ESCAPE '\\' AND i = n_roots THEN range(i, n + 1) ELSE [i] END) AS i, i AS own FROM summed
)
, extended AS (
  SELECT g.article, g.policy, g.n, g.i, {far} FROM steps g JOIN summed k ON k.article = g.article AND k.policy = g.policy AND k.i = g.own JOIN totals t ON t.article = g.article
)
, met AS (SELECT e.article, e.policy, e.n, e.i, {picked} FROM extended e {joins})
"""


def ratio_sql(f: str) -> str:
    d = f"(t_{f} - base_{f})"
    small = f"(1e-9 * greatest(1.0, abs(total_{f})))"
    up, down = f"(best_{f} - base_{f})", f"(base_{f} - worst_{f})"
    return f"CASE WHEN abs({d}) < {small} THEN 0.0 WHEN {d} > 0 THEN CASE WHEN {up} >= {small} THEN {d} / {up} ELSE 0.0 END ELSE CASE WHEN {down} >= {small} THEN {d} / {down} ELSE 0.0 END END"


def utility_sql(policies: tuple[str, ...], features: tuple[str, ...], cutoffs: tuple) -> str:
    wanted = ", ".join(f"'{p}'" for p in policies)
    rows = " UNION ALL ".join(
        f"SELECT article, policy, '{f}' AS feature, '{k}' AS cutoff, round(avg({ratio_sql(f)}), 6) + 0.0 AS value FROM met WHERE i < n {f'AND i <= {k}' if k != 'N' else ''} GROUP BY article, policy"
        if k == "N"
        else f"SELECT article, policy, '{f}' AS feature, '{k}' AS cutoff, round(avg({ratio_sql(f)}), 6) + 0.0 AS value FROM met WHERE i <= {k} AND ({k} < n OR i < n) GROUP BY article, policy"
        for f in features
        for k in cutoffs
    )
    return f"WITH {FORUM_SQL}, {KEYS_SQL} {curve_sql(features)} SELECT * FROM ({rows}) WHERE policy IN ({wanted})"


def grid_keys_sql(policies: tuple[P.Policy, ...], features: tuple[str, ...]) -> str:
    """The sort keys and ranks of any policies, for curve_sql."""
    named = {"pin_lr": "pred_nb", "pin_xgb": "pred_xgb"}
    rows = []
    for p in policies:
        column, descends = P.ORDERINGS[p.ordering]
        tree = p.layout == "rt"
        value = f"{'-' if descends else ''}{'r.' if tree else 'c.'}{named.get(column, column)}"
        pinned, place = ("r.pinned", "c.root_ord") if tree else ("c.pinned", "c.ord")
        tie = f"-{place}" if tree and p.ordering in P.REVERSED else place
        k0, k1, k2 = (f"CASE WHEN {pinned} THEN 0 ELSE 1 END", f"CASE WHEN {pinned} THEN {place} END", f"CASE WHEN NOT {pinned} THEN {value} END") if p.pinned else ("0", "NULL", value)
        rows.append(f"SELECT c.article, '{p.name}' AS policy, c.n, c.n_roots, c.ord, {', '.join(f'c.{f}' for f in features)}, {k0} AS k0, {k1} AS k1, CAST({k2} AS DOUBLE) AS k2, {tie} AS k3 FROM drawn c JOIN drawn r ON c.article = r.article AND c.root_ord = r.ord{' WHERE c.is_root' if p.layout == 'rh' else ''}")
    return f"""drawn AS (
  SELECT *, CAST(CAST('0x' || substr(md5(comment_id || '-7'), 1, 13) AS BIGINT) AS DOUBLE) AS random, count(*) OVER (PARTITION BY article) AS n,
         sum(CASE WHEN is_root THEN 1 ELSE 0 END) OVER (PARTITION BY article) AS n_roots
  FROM forum
), keyed AS ({' UNION ALL '.join(rows)}
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY article, policy ORDER BY k0 NULLS LAST, k1 NULLS LAST, k2 NULLS LAST, k3 NULLS LAST, ord) AS i FROM keyed
)"""


def grid_sql(features: tuple[str, ...], cutoffs: tuple) -> str:
    """scores: article, policy, feature, cutoff and value of the whole grid."""
    cells = [(f, k, "i < n" if k == "N" else f"i <= {k} AND ({k} < n OR i < n)") for f in features for k in cutoffs]
    wide = ", ".join(f'avg({ratio_sql(f)}) FILTER ({inside}) AS "{f}|{k}"' for f, k, inside in cells)
    return f"""WITH {FORUM_SQL}, {grid_keys_sql(P.GRID, features)} {curve_sql(features)}
, wide AS (SELECT article, policy, {wide} FROM met WHERE n > 100 GROUP BY article, policy)
, long AS (UNPIVOT wide ON COLUMNS(* EXCLUDE (article, policy)) INTO NAME cell VALUE x)
, scores AS (SELECT article, policy, split_part(cell, '|', 1) AS feature, split_part(cell, '|', 2) AS cutoff, round(x, 6) + 0.0 AS value FROM long)
, means AS (SELECT feature, cutoff, policy, avg(value) AS m FROM scores GROUP BY ALL)
, board AS (SELECT feature, cutoff, policy, round(m, 9) + 0.0 AS mean_value, CAST(row_number() OVER (PARTITION BY feature, cutoff ORDER BY round(m, 9) DESC, policy) AS INT) AS place, count(*) OVER (PARTITION BY feature, cutoff) AS last FROM means)
"""


def _forum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.long_discussions(forum_ranking(spark, sf_dir)).drop("n")


ONE_SQL = f"""
WITH {FORUM_SQL}, ranked AS (
  SELECT *, 'rev-chron_rl' AS policy, row_number() OVER (PARTITION BY article ORDER BY -ts, ord) AS i, count(*) OVER (PARTITION BY article) AS n, 0 AS n_roots FROM forum
) {curve_sql(("lexdiv",))}
SELECT article, policy, 'lexdiv' AS feature, '10' AS cutoff, round(avg({ratio_sql("lexdiv")}), 6) + 0.0 AS value FROM met WHERE i <= 10 AND n > 100 GROUP BY article, policy
UNION ALL SELECT article, policy, 'lexdiv', 'N', round(avg({ratio_sql("lexdiv")}), 6) + 0.0 FROM met WHERE i < n AND n > 100 GROUP BY article, policy
"""


@query(ONE_SQL)
def utility_rev_chron_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(U.utility(_forum(spark, sf_dir), ("lexdiv",), P.named("rev-chron_rl"), (10,)))


@query(utility_sql(SUBSET, ("lexdiv", "smog"), (10, 50, 100, "N")))
def utility_grid_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(U.utility(_forum(spark, sf_dir), ("lexdiv", "smog"), P.named(*SUBSET)))


def positions_sql(layout: str) -> str:
    return f"WITH {FORUM_SQL}, {KEYS_SQL} SELECT article, policy, CAST(i AS INT) AS position, comment_id FROM ranked WHERE policy LIKE '%\\_{layout}' ESCAPE '\\' AND n > 100"


@query(positions_sql("rt"))
def policy_positions_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.positions(_forum(spark, sf_dir), P.named(*[p for p in SUBSET if p.endswith("rt")]))


@query(positions_sql("rh"))
def policy_positions_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.positions(_forum(spark, sf_dir), P.named(*[p for p in SUBSET if p.endswith("rh")]))


@query(positions_sql("rl"))
def policy_positions_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.positions(_forum(spark, sf_dir), P.named(*[p for p in SUBSET if p.endswith("rl")]))


@query(f"WITH {FORUM_SQL}, {KEYS_SQL} {curve_sql(('smog',))} SELECT article, policy, i, round(t_smog, 4) + 0.0 AS t, round(base_smog, 4) + 0.0 AS base FROM met WHERE policy = 'pred-nb_rh'")
def hidden_interpolated_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = U.curves(_forum(spark, sf_dir), ("smog",), P.named("pred-nb_rh"))
    return rounded(c.select("article", "policy", "i", F.col("t_smog").alias("t"), F.col("base_smog").alias("base")), 4)


@query(f"""WITH {FORUM_SQL} SELECT article, comment_id, CAST(row_number() OVER (PARTITION BY article ORDER BY smog DESC, ord) AS INT) AS best, CAST(row_number() OVER (PARTITION BY article ORDER BY smog, ord) AS INT) AS worst FROM forum""")
def best_worst_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forum_ranking(spark, sf_dir).selectExpr("article", "comment_id", "row_number() over (partition by article order by smog desc, `order`) as best", "row_number() over (partition by article order by smog, `order`) as worst")


@query(f"""WITH scores AS ({utility_sql(SUBSET, ("lexdiv",), (10, "N"))}), means AS (SELECT feature, cutoff, policy, round(avg(value), 5) + 0.0 AS mean_value FROM scores GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY feature, cutoff ORDER BY mean_value DESC, policy) AS INT) AS place FROM means""")
def policy_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(U.leaderboard(rounded(U.utility(_forum(spark, sf_dir), ("lexdiv",), P.named(*SUBSET), (10,)))), 5)


@query(f"""WITH scores AS ({utility_sql(SUBSET, ("lexdiv",), (10, "N"))}), means AS (SELECT feature, cutoff, policy, round(avg(value), 5) + 0.0 AS mean_value FROM scores GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY feature, cutoff ORDER BY mean_value DESC, policy) AS p, count(*) OVER (PARTITION BY feature, cutoff) AS last FROM means)
SELECT feature, cutoff, policy, mean_value, CASE WHEN p = 1 THEN 'best' WHEN p = last THEN 'worst' ELSE 'default' END AS role FROM r WHERE p = 1 OR p = last OR policy = 'rev-chron_pinned_rt'""")
def policy_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(U.selected(rounded(U.utility(_forum(spark, sf_dir), ("lexdiv",), P.named(*SUBSET), (10,)))), 5)


@query(f"""WITH scores AS ({utility_sql(SUBSET, ("lexdiv",), ("N",))}) SELECT policy, round(quantile_cont(value, 0.25), 5) + 0.0 AS q25, round(quantile_cont(value, 0.5), 5) + 0.0 AS median, round(quantile_cont(value, 0.75), 5) + 0.0 AS q75 FROM scores GROUP BY policy""")
def quartiles_by_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = rounded(U.utility(_forum(spark, sf_dir), ("lexdiv",), P.named(*SUBSET), ()))
    return rounded(quartiles(scores, "value", "policy"), 5)


@query(f"""WITH {FORUM_SQL}, {KEYS_SQL} {curve_sql(("smog",))}, g AS (SELECT article, policy, i, CASE WHEN i < n THEN {ratio_sql("smog")} ELSE 0.0 END AS gamma FROM met WHERE policy = 'chron_rl')
SELECT article, policy, i, round(gamma, 5) + 0.0 AS gamma, round(avg(gamma) OVER (PARTITION BY article, policy ORDER BY i ROWS UNBOUNDED PRECEDING), 5) + 0.0 AS phi FROM g""")
def running_score_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(U.score_curve(_forum(spark, sf_dir), "smog", P.named("chron_rl")), 5)


@query(f"""WITH scores AS ({utility_sql(SUBSET, ("lexdiv",), ("N",))}) SELECT article, policy AS policy_name, value, split_part(policy, '_', 1) AS policy, split_part(policy, '_', -1) AS replies, CAST(contains(policy, 'pinned') AS INT) AS pinned,
CASE WHEN contains(policy, 'pinned') THEN concat_ws('_', split_part(policy, '_', 1), 'pinned', split_part(policy, '_', -1)) ELSE concat_ws('_', split_part(policy, '_', 1), split_part(policy, '_', -1)) END AS display,
CAST(policy LIKE '%\\_rh' ESCAPE '\\' AS INT) AS replies_rh, CAST(policy LIKE '%\\_rt' ESCAPE '\\' AS INT) AS replies_rt, CAST(policy LIKE '%\\_rl' ESCAPE '\\' AS INT) AS replies_rl FROM scores""")
def policy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = rounded(U.utility(_forum(spark, sf_dir), ("lexdiv",), P.named(*SUBSET), ())).select("article", F.col("policy").alias("policy_name"), "value")
    return dummies(P.parse_name(scores), "replies", ["rh", "rt", "rl"])


@query(f"""WITH scores AS ({utility_sql(SUBSET, ("lexdiv",), (10, "N"))}), wide AS (SELECT article, policy, max(value) FILTER (cutoff = '10') AS q10, max(value) FILTER (cutoff = 'N') AS qn FROM scores GROUP BY article, policy)
UNPIVOT (SELECT * FROM wide) ON q10, qn INTO NAME variable VALUE value""")
def melt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = rounded(U.utility(_forum(spark, sf_dir), ("lexdiv",), P.named(*SUBSET), (10,)))
    wide = scores.groupBy("article", "policy").agg(F.max(F.when(F.col("cutoff") == "10", F.col("value"))).alias("q10"), F.max(F.when(F.col("cutoff") == "N", F.col("value"))).alias("qn"))
    return melt(wide, ["article", "policy"], ["q10", "qn"])


@query(f"""WITH {FORUM_SQL} SELECT article, comment_id, round(coalesce(CASE WHEN min(x) OVER (PARTITION BY article) < 0 THEN x - min(x) OVER (PARTITION BY article) ELSE x END, 0), 6) + 0.0 AS x FROM (SELECT article, comment_id, coalesce(CASE WHEN sim > 0 THEN votes_rel * 1.0::DOUBLE END, 0) AS x FROM forum)""")
def shifted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forum_ranking(spark, sf_dir).select("article", "comment_id", F.when(F.col("sim") > 0, F.col("votes_rel").cast("double")).alias("x"))
    return rounded(U.format_scores(rows, ("x",), ("x",)))


def _grid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.utility(_forum(spark, sf_dir), ("lexdiv",), P.GRID, (10,)))


@query(f"""{grid_sql(("lexdiv",), (10, "N"))} SELECT feature, cutoff, policy, mean_value, place FROM board""")
def policy_leaderboard_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places among all 66 policies."""
    return rounded(U.leaderboard(_grid_scores(spark, sf_dir)), 9)


@query(f"""{grid_sql(("lexdiv",), (10, "N"))} SELECT feature, cutoff, policy, mean_value, CASE WHEN place = 1 THEN 'best' WHEN place = last THEN 'worst' ELSE 'default' END AS role FROM board WHERE place IN (1, last) OR policy = 'rev-chron_pinned_rt'""")
def policy_selection_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best, worst and default of all 66 policies."""
    return rounded(U.selected(_grid_scores(spark, sf_dir)), 9)


@query(f"""{grid_sql(("lexdiv",), ("N",))} SELECT policy, round(quantile_cont(value, 0.25), 8) + 0.0 AS q25, round(quantile_cont(value, 0.5), 8) + 0.0 AS median, round(quantile_cont(value, 0.75), 8) + 0.0 AS q75 FROM scores GROUP BY policy""")
def quartiles_by_policy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of each of the 66 policies."""
    # quartiles read the scores several times, and are a row per policy
    scores = rounded(grid.utility(_forum(spark, sf_dir), ("lexdiv",), cutoffs=()).select("policy", "value")).persist()
    try:
        found = rounded(quartiles(scores, "value", "policy"), 8)
        return spark.createDataFrame(found.collect(), found.schema)
    finally:
        scores.unpersist()


@query(f"""{grid_sql(FEATURES, (10, 50, 100, "N"))} SELECT feature, cutoff, policy, mean_value, place FROM board""")
def utility_full_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 66 policies, four features, four cut-offs; scores by policy over all discussions."""
    return rounded(U.leaderboard(rounded(grid.utility(_forum(spark, sf_dir), FEATURES))), 9)
