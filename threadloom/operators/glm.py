"""Regression models: logit, negative binomial (NB2) and beta.

Logit and NB2 are iteratively reweighted least squares: in each step every
partition of the rows sums its own weighted cross products, a matrix as wide as
the model and independent of the rows, and the driver solves. Beta regressions
over few cells of dummies need only counts and sums of logs by cell; these are
sufficient, so one aggregation is all that Spark does and Newton's steps run on
the driver.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.maths import two_sided_p
from threadloom.functions.sums import partition_sum


def expand(formula: str) -> tuple[str, list[tuple[str, ...]]]:
    """Response and terms of "y ~ a * (b + c) + d:e": a*b is a, b and a:b; main effects first, no term twice."""
    left, right = formula.split("~")
    signs = re.findall(r"[^\s+*:()]+|[+*:()]", right)

    def operand() -> list[tuple[str, ...]]:
        sign = signs.pop(0)
        if sign != "(":
            return [()] if sign == "1" else [(sign,)]
        inner = total()
        if not signs or signs.pop(0) != ")":
            raise ValueError(f"a bracket is open in {formula!r}")
        return inner

    def met(a: list[tuple[str, ...]], b: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
        return [tuple(sorted({*x, *y})) for x in a for y in b]

    def chain(sign: str, of, join) -> list[tuple[str, ...]]:
        out = of()
        while signs and signs[0] == sign:
            signs.pop(0)
            out = join(out, of())
        return out

    def together() -> list[tuple[str, ...]]:
        return chain(":", operand, met)

    def crossed() -> list[tuple[str, ...]]:
        return chain("*", together, lambda a, b: [*a, *b, *met(a, b)])

    def total() -> list[tuple[str, ...]]:
        return chain("+", crossed, lambda a, b: [*a, *b])

    terms = [t for t in dict.fromkeys(total()) if t]
    if signs:
        raise ValueError(f"{signs[0]!r} is out of place in {formula!r}")
    return left.strip(), sorted(terms, key=len)


def term_name(term: tuple[str, ...]) -> str:
    return ":".join(term)


def product(term: tuple[str, ...]) -> Column:
    out = F.lit(1.0)
    for c in term:
        out = out * F.col(f"`{c}`").cast("double")
    return out


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log gamma, for positive x: recurrence up to 6, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (small := x < 6).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    r = 1 / x**2
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    """Second derivative of log gamma, for positive x."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (small := x < 6).any():
        out[small] += 1 / x[small] ** 2
        x[small] += 1
    r = 1 / x**2
    return out + 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * 5 / 66))))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


@dataclass
class Fit:
    """A fitted model: everything that tables and predictions need."""

    family: str
    response: str
    terms: list[list[str]]
    estimates: list[float]
    errors: list[float]
    log_likelihood: float
    n: int
    extra: dict[str, float] = field(default_factory=dict)

    @property
    def k(self) -> int:
        return len(self.estimates) + len(self.extra)

    @property
    def aic(self) -> float:
        return 2 * self.k - 2 * self.log_likelihood

    @property
    def bic(self) -> float:
        return self.k * math.log(self.n) - 2 * self.log_likelihood

    def names(self) -> list[str]:
        return ["(Intercept)", *(term_name(tuple(t)) for t in self.terms)]

    def tidy(self, spark: SparkSession) -> DataFrame:
        """term, estimate, std_error, statistic, p_value."""
        rows = [(t, float(b), float(s), float(b / s) if s else None) for t, b, s in zip(self.names(), self.estimates, self.errors, strict=True)]
        df = spark.createDataFrame(rows, "term string, estimate double, std_error double, statistic double")
        return df.withColumn("p_value", two_sided_p("statistic"))

    def linear(self) -> Column:
        out = F.lit(float(self.estimates[0]))
        for t, b in zip(self.terms, self.estimates[1:], strict=True):
            out = out + product(tuple(t)) * float(b)
        return out

    def predicted(self) -> Column:
        """On the response's scale."""
        eta = self.linear()
        return F.exp(eta) if self.family == "nb2" else 1 / (1 + F.exp(-eta))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Fit:
        return Fit(**json.loads(text))


def model_matrix(df: DataFrame, formula: str) -> tuple[DataFrame, str, list[tuple[str, ...]]]:
    """(y, x) without rows that miss a value; x is an array with the intercept first."""
    response, terms = expand(formula)
    columns = sorted({c for t in terms for c in t} | {response})
    kept = df.select(*[f"`{c}`" for c in columns]).na.drop()
    return kept.select(F.col(response).cast("double").alias("y"), F.array(F.lit(1.0), *[product(t) for t in terms]).alias("x")), response, terms


def _sums(rows: DataFrame, step, size: int) -> np.ndarray:
    """The sum over all rows of step(x, y), an array of size numbers."""

    def of(batch: pa.RecordBatch) -> np.ndarray:
        return step(batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1), batch.column("y").to_numpy())

    return partition_sum(rows, of, size)


def _irls(rows: DataFrame, k: int, working, start: np.ndarray, steps: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    beta = start
    for _ in range(steps):

        def step(x: np.ndarray, y: np.ndarray, beta=beta) -> np.ndarray:
            w, z = working(x @ beta, y)
            xw = x * w[:, None]
            return np.concatenate([(xw.T @ x).ravel(), xw.T @ z])

        s = _sums(rows, step, k * k + k)
        gram = s[: k * k].reshape(k, k)
        new = np.linalg.solve(gram + 1e-10 * np.eye(k), s[k * k :])
        done = np.max(np.abs(new - beta)) < tolerance
        beta = new
        if done:
            break
    return beta, np.linalg.inv(gram + 1e-10 * np.eye(k))


def logit(df: DataFrame, formula: str, steps: int = 25, tolerance: float = 1e-8) -> Fit:
    """Logistic regression by maximum likelihood."""
    rows, response, terms = model_matrix(df, formula)
    rows = rows.persist()
    k = len(terms) + 1

    def working(eta: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mu = 1 / (1 + np.exp(-np.clip(eta, -30, 30)))
        w = np.maximum(mu * (1 - mu), 1e-10)
        return w, eta + (y - mu) / w

    beta, cov = _irls(rows, k, working, np.zeros(k), steps, tolerance)

    def likelihood(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        eta = x @ beta
        return np.array([np.sum(y * eta - np.logaddexp(0, eta)), len(y)])

    ll, n = _sums(rows, likelihood, 2)
    rows.unpersist()
    return Fit("logit", response, [list(t) for t in terms], beta.tolist(), np.sqrt(np.diag(cov)).tolist(), float(ll), int(n))


def negative_binomial(df: DataFrame, formula: str, rounds: int = 25, tolerance: float = 1e-7) -> Fit:
    """NB2 regression, variance mu + mu^2 / theta: weighted least squares for the
    coefficients given theta, and Newton steps for log theta given them, in turn."""
    rows, response, terms = model_matrix(df, formula)
    rows = rows.persist()
    k = len(terms) + 1
    total, n = _sums(rows, lambda x, y: np.array([y.sum(), len(y)]), 2)
    beta, theta = np.zeros(k), 1.0
    beta[0] = math.log(max(total / max(n, 1), 1e-8))
    cov = np.eye(k)
    for _ in range(rounds):

        def working(eta: np.ndarray, y: np.ndarray, theta=theta) -> tuple[np.ndarray, np.ndarray]:
            mu = np.exp(np.clip(eta, -30, 30))
            return mu / (1 + mu / theta), eta + (y - mu) / mu

        new, cov = _irls(rows, k, working, beta, 3, tolerance)

        def slope(x: np.ndarray, y: np.ndarray, theta=theta, new=new) -> np.ndarray:
            mu = np.exp(np.clip(x @ new, -30, 30))
            first = digamma(y + theta) - digamma(np.full_like(y, theta)) + np.log(theta) + 1 - np.log(mu + theta) - (y + theta) / (mu + theta)
            second = trigamma(y + theta) - trigamma(np.full_like(y, theta)) + 1 / theta - 2 / (mu + theta) + (y + theta) / (mu + theta) ** 2
            return np.array([first.sum(), second.sum()])

        g, h = _sums(rows, slope, 2)
        # in log theta: the derivative is theta g, its curvature theta^2 h + theta g
        curve = theta * theta * h + theta * g
        move = np.clip(-theta * g / curve if curve < 0 else math.copysign(0.5, g), -1, 1)
        done = abs(move) < 1e-6 and np.max(np.abs(new - beta)) < tolerance * 10
        beta, theta = new, theta * math.exp(move)
        if done:
            break

    def likelihood(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        mu = np.exp(np.clip(x @ beta, -30, 30))
        ll = _log_gamma(y + theta) - math.lgamma(theta) - _log_gamma(y + 1) + theta * np.log(theta / (mu + theta)) + y * np.log(mu / (mu + theta))
        return np.array([ll.sum()])

    (ll,) = _sums(rows, likelihood, 1)
    rows.unpersist()
    return Fit("nb2", response, [list(t) for t in terms], beta.tolist(), np.sqrt(np.diag(cov)).tolist(), float(ll), int(n), {"theta": float(theta)})


def beta_regression(df: DataFrame, formula: str, steps: int = 100, tolerance: float = 1e-9, most_cells: int = 10_000) -> Fit:
    """Beta regression with logit link and one precision, of a response inside (0, 1).

    The regressors must form few distinct rows (dummies): the cells, with their
    counts and sums of log y and log (1 - y), are what reaches the driver, and
    more than most_cells of them are refused.
    """
    response, terms = expand(formula)
    columns = sorted({c for t in terms for c in t})
    cells = df.select(response, *columns).na.drop().groupBy(*columns).agg(F.count("*").alias("_n"), F.sum(F.ln(response)).alias("_log"), F.sum(F.log1p(-F.col(response))).alias("_log1m")).limit(most_cells + 1).toPandas()
    if len(cells) > most_cells:
        raise ValueError(f"the regressors form more than {most_cells} cells")
    x = np.column_stack([np.ones(len(cells)), *[np.prod([cells[c].astype(float) for c in t], axis=0) for t in terms]])
    n, a, b = (cells[c].to_numpy(float) for c in ("_n", "_log", "_log1m"))
    k = x.shape[1]

    def state(p: np.ndarray) -> tuple[np.ndarray, float]:
        return 1 / (1 + np.exp(-np.clip(x @ p[:k], -30, 30))), math.exp(p[k])

    def ll(p: np.ndarray) -> float:
        mu, phi = state(p)
        return float(np.sum(n * (math.lgamma(phi) - _log_gamma(mu * phi) - _log_gamma((1 - mu) * phi)) + (mu * phi - 1) * a + ((1 - mu) * phi - 1) * b))

    p = np.zeros(k + 1)
    p[k] = 1.0
    info = np.eye(k + 1)
    for _ in range(steps):
        mu, phi = state(p)
        m = mu * (1 - mu)
        d1, d2 = digamma(mu * phi), digamma((1 - mu) * phi)
        t1, t2 = trigamma(mu * phi), trigamma((1 - mu) * phi)
        g_phi = np.sum(n * (digamma(np.array([phi]))[0] - mu * d1 - (1 - mu) * d2) + mu * a + (1 - mu) * b)
        score = np.append(x.T @ (phi * m * (a - b - n * (d1 - d2))), phi * g_phi)
        w = n * phi**2 * m**2 * (t1 + t2)
        cross = x.T @ (n * phi * m * (mu * t1 - (1 - mu) * t2)) * phi
        corner = np.sum(n * (mu**2 * t1 + (1 - mu) ** 2 * t2 - trigamma(np.array([phi]))[0])) * phi**2
        info = np.block([[x.T @ (x * w[:, None]), cross[:, None]], [cross[None, :], np.array([[corner]])]])
        move = np.linalg.solve(info + 1e-10 * np.eye(k + 1), score)
        before, size = ll(p), 1.0
        while size > 1e-6 and not ll(p + size * move) >= before - 1e-12:
            size /= 2
        p = p + size * move
        if np.max(np.abs(size * move)) < tolerance:
            break
    cov = np.linalg.inv(info + 1e-12 * np.eye(k + 1))
    return Fit("beta", response, [list(t) for t in terms], p[:k].tolist(), np.sqrt(np.diag(cov)[:k]).tolist(), ll(p), int(n.sum()), {"phi": math.exp(p[k])})


def fitted_all(specs: dict[str, callable], saved: dict[str, str] | None = None) -> dict[str, Fit]:
    """Fits of every specification that saved (JSON by name) doesn't hold yet."""
    found = {k: Fit.from_json(v) for k, v in (saved or {}).items()}
    for name, fit in specs.items():
        if name not in found:
            found[name] = fit()
    return found


def save_fits(spark: SparkSession, fits: dict[str, Fit], path: str) -> None:
    spark.createDataFrame([(k, f.to_json()) for k, f in fits.items()], "name string, fit string").coalesce(1).write.mode("overwrite").parquet(path)


def load_fits(spark: SparkSession, path: str) -> dict[str, Fit]:
    return {r["name"]: Fit.from_json(r["fit"]) for r in spark.read.parquet(path).collect()}


def damped(df: DataFrame, score: str) -> DataFrame:
    """Scores of replies times the least score of a root, so that no reply is above a root."""
    least = df.filter("is_root").agg(F.min(score).alias("_least"))
    return df.crossJoin(F.broadcast(least)).withColumn(score, F.when(F.col("is_root"), F.col(score)).otherwise(F.col(score) * F.col("_least"))).drop("_least")
