"""Tables that set models side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.maths import intervals, two_sided_p
from threadloom.operators.glm import Fit
from threadloom.operators.relational import average_rank


def difference(a: DataFrame, b: DataFrame, p_values: bool = True) -> DataFrame:
    """Coefficients of a minus those of b by term, with z test and intervals."""
    both = a.select("term", F.col("estimate").alias("coef_model1"), F.col("std_error").alias("_s1")).join(b.select("term", F.col("estimate").alias("coef_model2"), F.col("std_error").alias("_s2")), "term")
    out = both.withColumn("coef_diff", F.col("coef_model1") - F.col("coef_model2")).withColumn("se_diff", F.sqrt(F.col("_s1") * F.col("_s1") + F.col("_s2") * F.col("_s2"))).drop("_s1", "_s2")
    out = out.withColumn("z_value", F.col("coef_diff") / F.nullif(F.col("se_diff"), F.lit(0.0)))
    out = intervals(out, "coef_diff", "se_diff")
    return out.withColumn("p_value", two_sided_p("z_value")) if p_values else out


def compound(pins: DataFrame, up: DataFrame, down: DataFrame, p_values: bool = True) -> DataFrame:
    """Coefficients for picks minus the difference of those for up- and down-votes."""
    votes = difference(up, down, False).select("term", F.col("coef_diff").alias("estimate"), F.col("se_diff").alias("std_error"))
    return difference(pins, votes, p_values)


def aligned_coefficients(fits: dict[str, DataFrame], value: str = "estimate") -> DataFrame:
    """One column a model, for the terms of the model with the most; terms that a model lacks are null."""
    largest = max(fits, key=lambda name: fits[name].count())  # a row a term
    out = fits[largest].select("term", F.col(value).alias(largest))
    for name, df in fits.items():
        if name != largest:
            out = out.join(df.select("term", F.col(value).alias(name)), "term", "left")
    return out.select("term", *fits)


def criteria(spark: SparkSession, fits: dict[str, Fit]) -> DataFrame:
    """model, k, n, log_lik, aic, bic with the rank by BIC and the distance to the least."""
    rows = [(name, f.k, f.n, float(f.log_likelihood), float(f.aic), float(f.bic)) for name, f in fits.items()]
    df = spark.createDataFrame(rows, "model string, k int, n long, log_lik double, aic double, bic double")
    return df.withColumn("bic_rank", average_rank("bic").cast("int")).withColumn("bic_delta", F.col("bic") - F.min("bic").over(Window.partitionBy()))


def side_by_side_ranking(tables: dict[str, DataFrame], term: str = "term", value: str = "estimate") -> DataFrame:
    """Each table's terms from the highest value down, next to each other by place."""
    out = None
    for name, df in tables.items():
        ranked = df.select(F.row_number().over(Window.orderBy(F.col(value).desc(), term)).alias("place"), F.col(term).alias(f"{name}_term"), F.round(value, 3).alias(f"{name}_value"))
        out = ranked if out is None else out.join(ranked, "place", "full")
    return out


def interaction_sums(df: DataFrame, main: str = "main") -> DataFrame:
    """Main effect plus each policy's interaction effect, by interaction and variable."""
    base = df.filter(F.col("policy") == main).select("interaction", "variable", F.col("estimate").alias("_main"))
    return df.filter(F.col("policy") != main).join(base, ["interaction", "variable"]).withColumn("total", F.col("_main") + F.col("estimate")).drop("_main")


def markup(rows: list[dict], columns: list[str], caption: str = "") -> str:
    """A LaTeX table of formatted cells; what reaches it is a report, some dozen rows."""
    escape = {"_": r"\_", "%": r"\%", "&": r"\&"}

    def cell(v: object) -> str:
        text = "-" if v is None or v != v else f"{v:.3f}" if isinstance(v, float) else str(v)
        return "".join(escape.get(c, c) for c in text)

    lines = [r"\begin{table}", rf"\caption{{{cell(caption)}}}", rf"\begin{{tabular}}{{l{'r' * (len(columns) - 1)}}}", r"\hline", " & ".join(map(cell, columns)) + r" \\", r"\hline"]
    lines += [" & ".join(cell(r.get(c)) for c in columns) + r" \\" for r in rows]
    return "\n".join([*lines, r"\hline", r"\end{tabular}", r"\end{table}"])
