"""Table sources and sinks: Parquet, CSV with declared schemas, text summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.glm import Fit
from threadloom.operators.relational import global_number

COMMENTS = (
    "comment_id string, id string, article string, user_names string, user_follower string, timestamp string, heading string, text string, "
    "pinned string, is_root_comment int, is_leaf_comment int, level_in_tree int, root_of_tree string, votes_pos string, votes_neg string, `order` int"
)
ARTICLES = "url string, title string, subtitle string, genre1 string, genre2 string, genre3 string, date string, text string"


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table, or some of its columns only."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, row_names: bool = False) -> DataFrame:
    """A CSV file with a header; a leading column of row names is dropped, values may span lines."""
    full = f"_row string, {schema}" if row_names else schema
    df = spark.read.schema(full).option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "NA").csv(path)
    return df.select(*columns) if columns else df.drop("_row")


def write_csv(df: DataFrame, path: str, row_names: str | None = None) -> None:
    """A CSV file with a header; row_names: the column by whose order rows get a first column of numbers as names."""
    if row_names:
        df = global_number(df, row_names, [], "_row").select("_row", *df.columns)
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "NA").csv(path)


def checkpoint(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Write a stage's result as Parquet and go on from there."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def frontier(spark: SparkSession, first: str, last: str, base: str, genres: list[str]) -> DataFrame:
    """Day pages to visit: dates times genres, no leading zeros in the date."""
    days = spark.sql(f"select explode(sequence(date'{first}', date'{last}', interval 1 day)) as day")
    names = spark.createDataFrame([(g,) for g in genres], "genre string")
    path = F.regexp_replace(F.date_format("day", "/yyyy/MM/dd"), r"/0", "/")
    return days.crossJoin(F.broadcast(names)).select("genre", "day", F.concat(F.lit(base), F.col("genre"), path).alias("url"))


def repair(df: DataFrame, key: str, drop: DataFrame | None = None, fix: DataFrame | None = None, column: str | None = None) -> DataFrame:
    """Rows of drop (key) left out; column overwritten where fix (key, value) has the key."""
    if drop is not None:
        df = df.join(drop.select(key), key, "left_anti")
    if fix is not None and column:
        df = df.join(fix.select(key, F.col("value").alias("_fix")), key, "left").withColumn(column, F.coalesce("_fix", column)).drop("_fix")
    return df


def prefixed(df: DataFrame, column: str, prefix: str = "/") -> DataFrame:
    return df.filter(F.col(column).startswith(prefix))


def model_summary(lines: DataFrame) -> DataFrame:
    """Coefficient rows and fit statistics of model summaries in text form.

    lines: path, value. A coefficient row is a term, four numbers and maybe
    stars; the fit line is the row of numbers under the AIC header; the dispersion
    ends a line of its own and may be missing.
    """
    number = r"([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    row = rf"^\s*(\S+)\s+{number}\s+{number}\s+{number}\s+(<?\s*[0-9.eE+-]+)\s*[*.]*\s*$"
    fit = rf"^\s*{number}\s+{number}\s+{number}\s+{number}\s+([0-9]+)\s*$"
    v = F.col("value")

    def part(pattern: str, k: int) -> Column:
        return F.regexp_extract(v, pattern, k)

    coefficient = F.struct(
        part(row, 1).alias("term"),
        *[F.expr(f"try_cast(regexp_extract(value, r'{row}', {k}) as double)").alias(n) for k, n in ((2, "estimate"), (3, "std_error"), (4, "statistic"))],
        F.expr(f"try_cast(replace(replace(regexp_extract(value, r'{row}', 5), '<', ''), ' ', '') as double)").alias("p_value"),
    )
    dispersion = rf"^\s*Dispersion parameter.*:\s*{number}\s*$"
    found = lines.withColumn("d", F.when(v.rlike(dispersion), part(dispersion, 1).cast("double"))).withColumn("c", F.when(v.rlike(row) & ~v.rlike(fit), coefficient)).withColumn("f", F.when(v.rlike(fit), F.struct(*[part(fit, k).cast("double").alias(n) for k, n in ((1, "aic"), (2, "bic"), (3, "log_lik"))])))
    term = F.col("c.term")
    group = F.when(term.contains(":") & term.contains("pinned"), "pinned").when(term.contains(":") & term.contains("replies_rh"), "replies_rh").when(term.contains(":") & term.contains("replies_rt"), "replies_rt").otherwise("main")
    fits = found.filter("f is not null or d is not null").groupBy("path").agg(*[F.first(c, True).alias(n) for c, n in (("f.aic", "aic"), ("f.bic", "bic"), ("f.log_lik", "log_lik"), ("d", "dispersion"))])
    return found.filter("c is not null").select("path", "c.*", group.alias("part")).join(fits, "path", "left")


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    return model_summary(spark.read.text(path).select(F.input_file_name().alias("path"), "value"))


def summary_text(fit: Fit) -> str:
    """A model's summary as text: criteria, dispersion, then a row a term with stars; model_summary reads it back."""
    lines = [f" Family: {fit.family}", f"Formula: {fit.response} ~ {' + '.join(fit.names()[1:]) or '1'}", "", "      AIC       BIC    logLik  deviance  df.resid"]
    lines += [f"{fit.aic:.6f} {fit.bic:.6f} {fit.log_likelihood:.6f} {-2 * fit.log_likelihood:.6f} {fit.n - fit.k}", ""]
    lines += [f"Dispersion parameter for {fit.family} family (): {v:.9g}" for v in fit.extra.values()]
    lines += ["", "Conditional model:", "Estimate Std. Error z value Pr(>|z|)"]
    for term, estimate, error in zip(fit.names(), fit.estimates, fit.errors, strict=True):
        z = estimate / error if error else math.nan
        p = math.erfc(abs(z) / math.sqrt(2))
        marks = "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else "." if p < 0.1 else ""
        shown = "< 2e-16" if p < 2e-16 else f"{p:.6g}"
        lines.append(f"{term} {estimate:.9g} {error:.9g} {z:.9g} {shown} {marks}".rstrip())
    return "\n".join([*lines, "---"])


def write_summaries(spark: SparkSession, fits: dict[str, Fit], path: str) -> None:
    """One folder with a text file for each model, as path/name=..."""
    spark.createDataFrame([(k, summary_text(f)) for k, f in fits.items()], "name string, value string").write.mode("overwrite").partitionBy("name").text(path)
