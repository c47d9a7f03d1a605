"""Ranking utility: how far a policy moves readers from random to best or worst.

t(i) is the sum of a feature over a policy's first i comments; base(i) is i * T
/ N, the expected sum of a random order; best and worst sort by the feature
itself. The utility at a cut-off is the mean over i of d / (best - base) where d
= t - base is positive and of d / (base - worst) where it isn't.

One exchange by article serves everything: ranks and running sums of all
features come from one sort by (article, policy), and meet the best and worst
sums in a second local sort by (article, i) instead of a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.operators import policies as P

#: A difference below this share of the total is rounding, and counts as none.
NOISE = 1e-9


def format_scores(df: DataFrame, shift: tuple[str, ...], fill: tuple[str, ...]) -> DataFrame:
    """Per discussion: features of shift start at 0 if any is negative; nulls and NaN of fill are 0."""
    out = df.withColumns({f: F.coalesce(F.nanvl(f, F.lit(0.0)), F.lit(0.0)) for f in fill}) if fill else df
    least = {f: F.min(f).over(Window.partitionBy("article")) for f in shift}
    return out.withColumns({f: F.when(m < 0, F.col(f) - m).otherwise(F.col(f)) for f, m in least.items()})


def _sums(rows: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Position and running sums of each policy; sums of a hidden layout go on to the end in a straight line."""
    place = Window.partitionBy("article", "policy").orderBy(*P.sort_keys())
    upto = place.rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({"i": F.row_number().over(place)} | {f"t_{f}": F.sum(f).over(upto) for f in features})
    hidden = F.col("policy").endswith("_rh") & (F.col("i") == F.col("n_roots"))
    steps = F.when(hidden, F.sequence(F.col("i").cast("long"), F.col("n"))).otherwise(F.array(F.col("i").cast("long")))
    far = summed.withColumn("j", F.explode(steps))
    slope = {f: F.coalesce((F.col(f"total_{f}") - F.col(f"t_{f}")) / F.nullif(F.col("n") - F.col("i"), F.lit(0)), F.lit(0.0)) for f in features}
    totals = [F.col(f"total_{f}") for f in features]
    return far.select("article", "policy", "n", F.col("j").alias("i"), *totals, *[(F.col(f"t_{f}") + slope[f] * (F.col("j") - F.col("i"))).alias(f"t_{f}") for f in features])


def extremes(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """(article, i) with the running sums best_<feature> and worst_<feature> of each feature's own orders."""
    kinds = F.array(*[F.struct(F.lit(f"{end}_{f}").alias("policy"), (F.col(f) * sign).cast("double").alias("k2"), F.col(f).cast("double").alias("x")) for f in features for end, sign in (("best", -1), ("worst", 1))])
    ends = df.select("article", "order", F.explode(kinds).alias("e")).select("article", "order", "e.*")
    place = Window.partitionBy("article", "policy").orderBy(F.col("k2").asc_nulls_last(), "order")
    sums = ends.withColumn("i", F.row_number().over(place)).withColumn("v", F.sum("x").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    return sums.select("article", F.col("i").cast("long").alias("i"), *[F.when(F.col("policy") == name, F.col("v")).alias(name) for name in _ends(features)])


def _ends(features: tuple[str, ...]) -> list[str]:
    return [f"{end}_{f}" for f in features for end in ("best", "worst")]


def curves(df: DataFrame, features: tuple[str, ...], policies: tuple[P.Policy, ...] = P.GRID, seed: int = 7, compat: bool = False, interpolate: bool = True, presorted: DataFrame | None = None, precomputed: DataFrame | None = None) -> DataFrame:
    """(article, policy, n, i) with total, t, best, worst and base of every feature.

    interpolate: extend hidden layouts to all comments; else they end with the
    comments they show. presorted: extremes() of the same comments and features,
    made before. precomputed: (article, i, base_<feature>), a baseline to take
    instead of that of random orders.
    """
    whole = Window.partitionBy("article")
    about = df.withColumns({"n": F.count("*").over(whole), "n_roots": F.sum(F.col("is_root").cast("int")).over(whole)} | {f"total_{f}": F.sum(f).over(whole) for f in features})
    # the exchange by article is made once; what follows only sorts inside it
    keyed = P.exploded(about, policies, seed, compat)
    rows = _sums(keyed, features)
    if not interpolate:
        rows = rows.join(about.groupBy("article").agg(F.max("n_roots").alias("n_roots")), "article").filter("not endswith(policy, '_rh') or i <= n_roots")
    both = rows.unionByName(extremes(about, features) if presorted is None else presorted, allowMissingColumns=True)
    at = Window.partitionBy("article", "i")
    met = both.withColumns({name: F.max(name).over(at) for name in _ends(features)}).filter("policy is not null")
    if precomputed is not None:
        return met.join(precomputed.select("article", "i", *[f"base_{f}" for f in features]), ["article", "i"])
    return met.withColumns({f"base_{f}": F.col("i") * F.col(f"total_{f}") / F.col("n") for f in features})


def ratio(f: str, on_zero: str = "zero") -> Column:
    """The normalised difference at one position; on_zero: zero or skip where it is 0 / 0."""
    d = F.col(f"t_{f}") - F.col(f"base_{f}")
    d = F.when(F.abs(d) < NOISE * F.greatest(F.lit(1.0), F.abs(F.col(f"total_{f}"))), F.lit(0.0)).otherwise(d)
    up, down = F.col(f"best_{f}") - F.col(f"base_{f}"), F.col(f"base_{f}") - F.col(f"worst_{f}")
    small = NOISE * F.greatest(F.lit(1.0), F.abs(F.col(f"total_{f}")))
    by = F.when(d > 0, up).otherwise(down)
    value = F.when(F.abs(by) >= small, d / by)
    return F.coalesce(value, F.lit(0.0)) if on_zero == "zero" else value


def utility(df: DataFrame, features: tuple[str, ...], policies: tuple[P.Policy, ...] = P.GRID, cutoffs: tuple[int, ...] = (10, 50, 100), on_zero: str = "zero", **options) -> DataFrame:
    """(article, policy, feature, cutoff, value): cutoff "N" is the whole discussion but its last place.

    grid.utility gives the same for many policies without their rows by place.
    """
    c = curves(df, features, policies, **options)
    means = []
    for f in features:
        r = ratio(f, on_zero)
        for k in cutoffs:
            inside = (F.col("i") <= k) & ((F.lit(k) < F.col("n")) | (F.col("i") < F.col("n")))
            means.append(F.avg(F.when(inside, r)).alias(f"{f}|{k}"))
        means.append(F.avg(F.when(F.col("i") < F.col("n"), r)).alias(f"{f}|N"))
    wide = c.groupBy("article", "policy").agg(*means)
    return long(wide, cells(features, cutoffs))


def cells(features: tuple[str, ...], cutoffs: tuple[int, ...]) -> list[str]:
    """Names of the columns of means: feature and cut-off."""
    return [f"{f}|{k}" for f in features for k in (*cutoffs, "N")]


def long(wide: DataFrame, names: list[str]) -> DataFrame:
    """(article, policy, feature, cutoff, value) of such columns."""
    values = F.array(*[F.struct(F.lit(n.split("|")[0]).alias("feature"), F.lit(n.split("|")[1]).alias("cutoff"), F.col(f"`{n}`").alias("value")) for n in names])
    return wide.select("article", "policy", F.explode(values).alias("c")).select("article", "policy", "c.*")


def score_curve(df: DataFrame, feature: str, policies: tuple[P.Policy, ...], **options) -> DataFrame:
    """(article, policy, i, gamma, phi): the normalised difference and its running mean."""
    c = curves(df, (feature,), policies, **options)
    gamma = c.withColumn("gamma", F.when(F.col("i") < F.col("n"), ratio(feature)).otherwise(F.lit(0.0)))
    upto = Window.partitionBy("article", "policy").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return gamma.withColumn("phi", F.avg("gamma").over(upto)).select("article", "policy", "i", "gamma", "phi")


def leaderboard(scores: DataFrame) -> DataFrame:
    """Mean utility by feature, cut-off and policy, with its rank from the top.

    Means that agree to nine digits are tied, and ranked by name: policies of equal
    scores keep their places whatever order the scores were added in.
    """
    means = scores.groupBy("feature", "cutoff", "policy").agg(F.avg("value").alias("mean_value"))
    top = Window.partitionBy("feature", "cutoff").orderBy(F.round("mean_value", 9).desc(), "policy")
    return means.withColumn("place", F.row_number().over(top))


def selected(scores: DataFrame, default: str = "rev-chron_pinned_rt") -> DataFrame:
    """The best, the worst and the default policy of each feature and cut-off."""
    board = leaderboard(scores)
    last = F.max("place").over(Window.partitionBy("feature", "cutoff"))
    role = F.when(F.col("place") == 1, "best").when(F.col("place") == last, "worst").when(F.col("policy") == default, "default")
    return board.withColumn("role", role).filter("role is not null").drop("place")


def matrix(scores: DataFrame, feature: str, cutoff: str, policies: tuple[P.Policy, ...]) -> DataFrame:
    """One feature's scores at one cut-off: a row a discussion, a column a policy; null where a score is missing."""
    cells = scores.filter((F.col("feature") == feature) & (F.col("cutoff") == cutoff))
    return cells.groupBy("article").pivot("policy", [p.name for p in policies]).agg(F.first("value"))


def from_matrix(wide: DataFrame, feature: str, cutoff: str) -> DataFrame:
    """The long scores of such a matrix, without the missing ones."""
    long = wide.unpivot(["article"], [c for c in wide.columns if c != "article"], "policy", "value")
    return long.filter("value is not null").select("article", "policy", F.lit(feature).alias("feature"), F.lit(cutoff).alias("cutoff"), "value")


def export(scores: DataFrame, path: str) -> None:
    """Long scores as Parquet, a folder for each feature and cut-off."""
    scores.write.mode("overwrite").partitionBy("feature", "cutoff").parquet(path)


def ingest(spark: SparkSession, path: str, cutoffs: tuple[str, ...] = ("10", "N")) -> DataFrame:
    """Exported scores of some cut-offs; the folders of others aren't read."""
    kept = spark.read.schema("article long, policy string, value double, feature string, cutoff string").parquet(path).filter(F.col("cutoff").isin(*cutoffs))
    return kept.select("article", "policy", "feature", "cutoff", "value")
