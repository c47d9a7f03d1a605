"""Utilities of many policies at once, in arrays: a discussion's rows are sorted once an ordering, not once a policy.

The window plan of utility.curves makes a row per comment, policy and place:
for the whole grid 66 of each comment, all sorted. Here a discussion's rows reach
one call, in which each ordering is one sort of its rows and one of its roots;
layouts and pinned-first are derived from these by stable selection, and only a
row per policy leaves the call. Policies are scored in blocks of CELLS numbers,
so that memory grows with the discussion and not with policies times comments.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import policies as P
from threadloom.operators import utility as U

#: Policies times places that are scored at once.
CELLS = 1 << 17


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values, 0 where null, and where they are null."""
    null = column.is_null().to_numpy()
    return column.fill_null(0).to_numpy() if null.any() else column.to_numpy(), null


def _flags(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(False).to_numpy(), column.is_null().to_numpy()


def _codes(value: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Ranks of values from 0, equal ones alike: numbers, NaN, null."""
    _, code = np.unique(value, return_inverse=True)
    return np.where(null, len(value), code)


class Discussion:
    """The rows of one discussion by their place, with what policies sort by."""

    def __init__(self, rows: pa.Table, orderings: list[str], compat: bool) -> None:
        self.compat = compat
        order = rows.column("order").to_numpy()
        if (order[1:] < order[:-1]).any():
            rows = rows.take(np.argsort(order, kind="stable"))
            order = rows.column("order").to_numpy()
        self.rows, self.order, self.n = rows, order, len(order)
        self.is_root, _ = _flags(rows.column("is_root"))
        self.pinned, self.unknown = _flags(rows.column("pinned"))
        self.roots, self.tree = self._trees()
        self.n_roots = int(self.is_root.sum())
        self.codes = {}
        for name in orderings:
            column, descends = P.ORDERINGS[name]
            value, null = _numbers(rows.column(column))
            self.codes[name] = _codes(-value.astype(float) if descends else value.astype(float), null)
        self.plain: dict[tuple, np.ndarray] = {}

    def _trees(self) -> tuple[np.ndarray, np.ndarray]:
        """The row of each tree's root, and each row's tree as a number; rows without a root have the number after the last."""
        key = self.rows.column("root_of_tree").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        at = np.flatnonzero(self.is_root)
        if len(np.unique(key[at])) < len(at):  # of several roots of a tree the greatest row counts
            names = [*sorted({c for c, _ in P.ORDERINGS.values()}), "pinned", "order"]
            sides = [x for name in names for x in ((~self.rows.column(name).is_null().to_numpy()), _numbers(self.rows.column(name))[0] if name != "pinned" else self.pinned)]
            at = at[np.lexsort([s[at] for s in reversed(sides)])]
        found = np.full(key.max(initial=0) + 1, -1)
        found[key[at]] = at
        roots = np.sort(found[found >= 0])
        place = np.full(self.n + 1, len(roots))
        place[roots] = np.arange(len(roots))
        return roots, place[np.where(found[key] >= 0, found[key], self.n)]

    def loose(self, p: P.Policy) -> np.ndarray:
        """Rows in the order of a policy that ranks comments one by one."""
        code = self.codes[p.ordering]
        if p.pinned and self.unknown.any():
            # neither pinned nor not: no key, so with those that have none
            code = np.where(self.unknown, self.n, code)
        name = (p.ordering, p.pinned and self.unknown.any())
        if name not in self.plain:
            self.plain[name] = np.argsort(code, kind="stable")
        rows = self.plain[name]
        return np.concatenate([np.flatnonzero(self.pinned), rows[~self.pinned[rows]]]) if p.pinned else rows

    def trees(self, p: P.Policy) -> np.ndarray:
        """Rows of whole trees in the order of their roots; those without a root come after all that aren't in a last stratum of picks."""
        roots = self.roots
        code, pinned = self.codes[p.ordering][roots], self.pinned[roots]
        tie = -roots if p.ordering in P.REVERSED else roots
        rootless = 2 * len(roots)
        if not p.pinned:
            by = np.lexsort((tie, code))
        elif self.compat and p.ordering == "least-neg-abs":
            key = np.where(self.unknown[roots], self.n, self.codes["neg-abs"][roots])
            by = np.lexsort((tie, np.where(pinned, 0, key), np.where(pinned, -roots, 0), pinned))
            rootless = 2 * int((~pinned).sum()) - 1
        else:
            key = np.where(self.unknown[roots], self.n, code)
            by = np.lexsort((tie, np.where(pinned, 0, key), np.where(pinned, roots, 0), ~pinned))
        rank = np.full(len(roots) + 1, rootless)
        rank[by] = 2 * np.arange(len(roots))
        return np.argsort(rank[self.tree], kind="stable")

    def ranked(self, p: P.Policy) -> np.ndarray:
        if p.layout == "rt":
            return self.trees(p)
        rows = self.loose(p)
        return rows[self.is_root[rows]] if p.layout == "rh" else rows


def _means(d: Discussion, ranks: np.ndarray, f: str, ends: dict, cutoffs: list[int], skip: bool) -> np.ndarray:
    """Mean ratios of policies (rows of ranks) at cut-offs; NaN where there is none."""
    n, shown = d.n, ranks.shape[1]
    x, null, total, known, best, worst = ends[f]
    t = np.cumsum(x[ranks], axis=1)
    # sums are null before the first value
    met = np.cumsum(~null[ranks], axis=1) > 0 if null.any() else None
    if shown < n:
        last = t[:, -1:]
        slope = (total - last) / (n - shown)
        if met is not None:
            slope = np.where(met[:, -1:], slope, 0.0)
            met = np.concatenate([met, np.repeat(met[:, -1:], n - shown, axis=1)], axis=1)
        t = np.concatenate([t, last + slope * np.arange(1, n - shown + 1)], axis=1)
    if not known:
        met = np.zeros(t.shape, bool)
    base = np.arange(1, n + 1) * total / n
    small = U.NOISE * max(1.0, abs(total))
    t -= base
    t[np.abs(t) < small] = 0.0
    by = np.where(t > 0, best - base, base - worst)
    none = np.abs(by) < small
    by[none] = 1.0
    t /= by
    t[none] = 0.0
    if met is not None:
        t[~met] = 0.0
        none |= ~met
    out = np.full((len(ranks), len(cutoffs)), np.nan)
    for at, k in enumerate(cutoffs):
        m = min(k, n - 1)
        if m < 1:
            continue
        sums = t[:, :m].sum(axis=1)
        count = m - none[:, :m].sum(axis=1) if skip else np.full(len(ranks), m)
        out[:, at] = np.where(count > 0, sums / np.maximum(count, 1), np.nan)
    return out


def _ends(d: Discussion, f: str) -> tuple:
    """A feature's values, which are null, their total, whether any is known, and the sums of its own two orders."""
    x, null = _numbers(d.rows.column(f))
    x = x.astype(float)
    code = {sign: np.where(null, d.n, _codes(sign * x, null)) for sign in (-1.0, 1.0)}
    best, worst = (np.cumsum(x[np.argsort(code[sign], kind="stable")]) for sign in (-1.0, 1.0))
    return x, null, float(np.cumsum(x)[-1]), not null.all(), best, worst


def scored(rows: pa.Table, features: tuple[str, ...], policies: tuple[P.Policy, ...], cutoffs: tuple[int, ...], skip: bool, compat: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Policies that show a comment, with a mean per feature and cut-off, and where it is missing."""
    d = Discussion(rows, sorted({p.ordering for p in policies} | ({"neg-abs"} if compat else set())), compat)
    ends = {f: _ends(d, f) for f in features}
    wanted = [*cutoffs, d.n]
    names, parts = [], []
    for hidden in (True, False):
        shown = d.n_roots if hidden else d.n
        own = [p for p in policies if (p.layout == "rh") == hidden] if shown else []
        step = max(1, CELLS // d.n)
        for at in range(0, len(own), step):
            block = own[at : at + step]
            ranks = np.stack([d.ranked(p) for p in block])
            names += [p.name for p in block]
            parts.append(np.concatenate([_means(d, ranks, f, ends, wanted, skip) for f in features], axis=1))
    values = np.concatenate(parts) if parts else np.empty((0, len(features) * len(wanted)))
    # a mean over places is missing where there are none, or where skipping leaves none; NaN of a feature is a value
    nan = np.array([np.isnan(ends[f][2]) for f in features]).repeat(len(wanted))
    few = np.array([min(k, d.n - 1) < 1 for k in wanted] * len(features))
    return names, values, np.isnan(values) & ~(nan & ~few)


def utility(df: DataFrame, features: tuple[str, ...], policies: tuple[P.Policy, ...] = P.GRID, cutoffs: tuple[int, ...] = (10, 50, 100), on_zero: str = "zero", seed: int = 7, compat: bool = False) -> DataFrame:
    """What utility.utility returns, without its rows by place; hidden layouts are extended to all comments."""
    drawn = df.withColumn("random", P.random_key(seed))
    numbers = sorted({c for c, _ in P.ORDERINGS.values()} | {*features})
    rows = drawn.select("article", "order", "is_root", "pinned", "root_of_tree", *[F.col(c).cast("double").alias(c) for c in numbers])
    names = U.cells(features, cutoffs)

    def score(group: pa.Table) -> pa.Table:
        found, values, missing = scored(group, features, policies, cutoffs, on_zero == "skip", compat)
        article = group.column("article").combine_chunks()
        return pa.table(
            [pa.array([article[0].as_py()] * len(found), article.type), pa.array(found, pa.string()), *[pa.array(values[:, k], mask=missing[:, k]) for k in range(len(names))]],
            names=["article", "policy", *[f"c{k}" for k in range(len(names))]],
        )

    kind = dict(df.dtypes)["article"]
    wide = rows.groupBy("article").applyInArrow(score, f"article {kind}, policy string, {', '.join(f'c{k} double' for k in range(len(names)))}")
    return U.long(wide.withColumnsRenamed({f"c{k}": name for k, name in enumerate(names)}), names)
