"""Reshaping, counting and statistics over tables of any kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.maths import correlation_p


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]


def running_sums(df: DataFrame, key: str, columns: list[str], by: list[str] | None = None, descending: bool = False, parts: int = 64) -> DataFrame:
    """Running sums <column>_upto of columns in the order of key, and their sums <column>_all.

    Quantiles of the key cut the rows of each group into at most parts buckets;
    sums run inside a bucket, after those of the buckets before it, so that no
    group is one task. key: a number, each at most once in a group (count ties
    before); null counts as the least. What joins back is parts rows a group.
    """
    # a group is known by its columns as text, in which nulls and one group of all rows are like any other
    group = F.to_json(F.struct(*by)) if by else F.lit("")
    value = F.col(key).cast("double")
    keyed = df.withColumn("_group", group)
    cuts = keyed.groupBy("_group").agg(F.percentile_approx(value, [k / parts for k in range(1, parts)], 10 * parts).alias("_cuts"))
    bucket = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c < value))
    placed = keyed.join(cuts, "_group").withColumn("_bucket", bucket).drop("_cuts")
    totals = placed.groupBy("_group", "_bucket").agg(*[F.sum(c).alias(c) for c in columns])
    groups = Window.partitionBy("_group")
    earlier = groups.orderBy(F.col("_bucket").desc() if descending else F.col("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_group", "_bucket", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before_{c}") for c in columns], *[F.sum(c).over(groups).alias(f"{c}_all") for c in columns])
    inside = Window.partitionBy("_group", "_bucket").orderBy(F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    met = placed.join(before, ["_group", "_bucket"]).withColumns({f"{c}_upto": F.sum(c).over(inside) + F.col(f"_before_{c}") for c in columns})
    return met.drop("_group", "_bucket", *[f"_before_{c}" for c in columns])


def percentiles(df: DataFrame, column: str, shares: dict[str, float], *by: str) -> DataFrame:
    """Exact percentiles with linear interpolation, by groups; nulls don't count, and a group of nulls has null.

    Equal values are counted first; the counts run in buckets, so that neither all
    values nor a group's are held by one task.
    """
    # null is a value that counts 0 times, which keeps groups of nulls only
    counts = df.groupBy(*by, F.col(column).cast("double").alias("_v")).agg(F.count(column).alias("_n"))
    ranked = running_sums(counts, "_v", ["_n"], list(by))
    at = {name: F.lit(share) * (F.col("_n_all") - 1) for name, share in shares.items()}
    ends = [F.min(F.when(F.col("_n_upto") > f(place), F.col("_v"))).alias(f"_{end}_{name}") for name, place in at.items() for end, f in (("low", F.floor), ("high", F.ceil))]
    found = ranked.groupBy(*by).agg(F.max("_n_all").alias("_n_all"), *ends)
    part = {name: place - F.floor(place) for name, place in at.items()}
    return found.select(*by, *[(F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * p).alias(name) for name, p in part.items()])


QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def profile(df: DataFrame) -> DataFrame:
    """Minimum, quartiles, mean and maximum of each numeric column, one row a column."""
    columns = numeric_columns(df)
    wide = df.agg(*[F.struct(F.min(c).cast("double").alias("min"), F.avg(c).alias("mean"), F.max(c).cast("double").alias("max")).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("s")) for c in columns])
    ends = wide.select(F.explode(cells).alias("x")).select("x.column", "x.s.*")
    long = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    return ends.join(percentiles(long, "value", QUARTILES, "column"), "column", "left").select("column", "min", *QUARTILES, "mean", "max")


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / sample standard deviation; one aggregation, joined as a single row."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns])
    return df.crossJoin(F.broadcast(stats)).withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)) for c in columns}).drop(*stats.columns)


def dummies(df: DataFrame, column: str, levels: list, base: str | None = None, prefix: str | None = None) -> DataFrame:
    """0/1 columns of the levels, without that of the base level."""
    return df.withColumns({f"{prefix or column}_{v}": (F.col(column) == v).cast("int") for v in levels if v != base})


def first_per_group(df: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def global_number(df: DataFrame, key: str, ties: list[str], name: str, parts: int = 64) -> DataFrame:
    """Row numbers over all rows by key and ties, from 1, without bringing all rows to one task.

    Quantiles of the key cut the rows into parts buckets; rows are numbered inside
    a bucket, after the counts of the buckets before it. What the driver holds is
    a number a bucket. key: a number, date or time; null keys come first.
    """
    value = F.expr(f"cast(cast(`{key}` as timestamp) as double)") if dict(df.dtypes)[key] in ("date", "timestamp", "timestamp_ntz") else F.col(key).cast("double")
    cuts = df.select(F.percentile_approx(value, [k / parts for k in range(1, parts)], 10 * parts).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    above = [F.when(value > c, k + 1) for k, c in reversed(list(enumerate(cuts)))]
    placed = df.withColumn("_bucket", F.coalesce(*above, F.lit(0)))
    counts = {r["_bucket"]: r["n"] for r in placed.groupBy("_bucket").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for k in range(len(cuts) + 1):
        before.append(total)
        total += counts.get(k, 0)
    inside = Window.partitionBy("_bucket").orderBy(F.col(key).asc_nulls_first(), *ties)
    first = F.element_at(F.array(*[F.lit(n).cast("long") for n in before]), F.col("_bucket") + 1)
    return placed.withColumn(name, F.row_number().over(inside) + first).drop("_bucket")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums made in another order compare equal."""
    return df.withColumns({c: F.round(c, digits) + 0.0 for c, t in df.dtypes if t == "double"})


def correlations(df: DataFrame, columns: list[str], least: float | None = None) -> DataFrame:
    """Pearson correlation of each pair of columns, long; least: weaker ones are null."""
    pairs = [(a, b) for a in columns for b in columns]
    place = {c: k for k, c in enumerate(columns)}
    once = [p for p in pairs if place[p[0]] <= place[p[1]]]
    wide = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in once])
    value = {p: F.col(f"`{'|'.join(sorted(p, key=place.get))}`") for p in pairs}
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.when(F.abs(value[a, b]) > least, value[a, b]) if least else value[a, b]).alias("r")) for a, b in pairs])
    return wide.select(F.explode(cells).alias("c")).select("c.*")


def average_rank(column: str, by: list[str] | None = None) -> Column:
    """Rank with ties at their mean."""
    w = Window.partitionBy(*(by or [])).orderBy(column)
    ties = Window.partitionBy(*(by or []), column)
    return F.rank().over(w) + (F.count("*").over(ties) - 1) / 2.0


def spearman(df: DataFrame, a: str, b: str, p_values: bool = False) -> DataFrame:
    """Pearson and Spearman correlation of two columns and the number of rows; p_values: with pearson_p and spearman_p.

    Ranks with ties at their mean come from running counts of distinct values.
    """
    rows = df.select(F.col(a).alias("_a"), F.col(b).alias("_b")).na.drop()
    ranked = rows
    for c in ("_a", "_b"):
        counts = running_sums(rows.groupBy(c).agg(F.count("*").alias("_n")), c, ["_n"])
        ranked = ranked.join(counts.select(c, (F.col("_n_upto") - (F.col("_n") - 1) / 2.0).alias(f"_r{c}")), c)
    out = ranked.agg(F.corr("_a", "_b").alias("pearson"), F.corr("_r_a", "_r_b").alias("spearman"), F.count("*").alias("n"))
    return out.withColumns({f"{r}_p": correlation_p(r, "n") for r in ("pearson", "spearman")}) if p_values else out


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int, by: list[str] | None = None) -> DataFrame:
    """Counts in equal bins; 0 is below the range, bins + 1 above."""
    return df.withColumn("bucket", F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)).cast("long")).groupBy(*(by or []), "bucket").agg(F.count("*").alias("n"))


def quartiles(df: DataFrame, column: str, *by: str) -> DataFrame:
    return percentiles(df, column, QUARTILES, *by)


def density(df: DataFrame, column: str, low: float, high: float, points: int, width: float, *by: str) -> DataFrame:
    """Gaussian kernel density at evenly spaced points, by groups.

    Rows are first counted in bins a tenth of the width wide, so that the work
    follows the range and not the rows.
    """
    step = width / 10
    bins = df.withColumn("_b", F.round(F.col(column) / step)).groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    at = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.lit(low) + k * ((high - low) / (points - 1)))
    spread = bins.withColumn("x", F.explode(at)).withColumn("_k", F.col("_c") * F.exp(-F.pow((F.col("x") - F.col("_b") * step) / width, F.lit(2)) / 2))
    sums = spread.groupBy(*by, "x").agg(F.sum("_k").alias("_k"), F.sum("_c").alias("_n"))
    return sums.select(*by, "x", (F.col("_k") / (F.col("_n") * width * 2.5066282746310002)).alias("density"))


def row_rank(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rank of each column within its row, ties at their mean cut to whole numbers; long."""
    long = df.select(*key, F.explode(F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).alias("value")) for c in columns])).alias("e")).select(*key, "e.*")
    return long.withColumn("place", average_rank("value", key).cast("int"))


def two_smallest(df: DataFrame, columns: list[str]) -> DataFrame:
    """The least and second least value of some columns of each row."""
    s = F.sort_array(F.array(*columns))
    return df.withColumns({"best": s[0], "second": s[1]})


def baseline_difference(df: DataFrame, columns: list[str], base: str) -> DataFrame:
    return df.withColumns({f"{c}_delta": F.col(c) - F.col(base) for c in columns})


def labelled_lookup(df: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """Rows by an ordered list of labels, with each label's place; a label may have several rows."""
    listed = df.sparkSession.createDataFrame(list(enumerate(labels)), f"ord int, {column} string")
    return df.join(F.broadcast(listed), column)


def aligned(tables: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """One column of each table side by side, by key, outer."""
    out = None
    for name, df in tables:
        side = df.select(key, F.col(value).alias(name))
        out = side if out is None else out.join(side, key, "full")
    return out


def melt(df: DataFrame, key: list[str], columns: list[str], names: str = "variable", values: str = "value") -> DataFrame:
    return df.unpivot(key, columns, names, values)


def rows_between(df: DataFrame, key: str, ties: list[str], first: int, last: int | None = None) -> DataFrame:
    """Rows by place in an order, from first to last, both included and counted from 1; last: to the end."""
    numbered = global_number(df, key, ties, "_place")
    kept = numbered.filter(F.col("_place") >= first) if last is None else numbered.filter(F.col("_place").between(first, last))
    return kept.drop("_place")


def beside(tables: list[tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """Tables side by side by place: each (table, key, ties) is numbered in its own order; shorter ones end in nulls."""
    out = None
    for df, key, ties in tables:
        side = global_number(df, key, ties, "place")
        out = side if out is None else out.join(side, "place", "full")
    return out


def columns_without_nulls(df: DataFrame) -> DataFrame:
    """The columns that hold no null, found in one pass; of an empty table all."""
    found = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns]).first()
    return df.select(*[f"`{c}`" for c in df.columns if not found[c]])


def complete_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without null or NaN in some columns, or in any."""
    return df.na.drop(subset=list(columns) or None)
