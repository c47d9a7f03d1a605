"""Ranking policies as a declared table, and their positions in one pass.

A policy is an ordering, with pinned comments first or not, and a layout:
replies hidden (rh), shown in trees under their root (rt), or loose (rl). Every
policy becomes the same five sort keys, so that all policies of a discussion are
one explode, one sort and one window instead of a sort and a copy each.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAYOUTS = ("rh", "rt", "rl")

#: Orderings with the column they sort by and whether it descends.
ORDERINGS = {
    "chron": ("ts", False),
    "rev-chron": ("ts", True),
    "pos-abs": ("votes_pos", True),
    "pos-rel": ("votes_rel", True),
    "neg-abs": ("votes_neg", True),
    "least-neg-abs": ("votes_neg", False),
    "pred-nb": ("pred_nb", True),
    "pred-xgb": ("pred_xgb", True),
    "pin-pred-lr": ("pin_lr", True),
    "pin-pred-xgb": ("pin_xgb", True),
    "random": ("random", False),
}
#: Orderings whose trees are a reversed ranking, so that ties of roots are reversed too.
REVERSED = ("rev-chron", "least-neg-abs")


@dataclass(frozen=True)
class Policy:
    ordering: str
    layout: str
    pinned: bool = False

    @property
    def name(self) -> str:
        return f"{self.ordering}{'_pinned' * self.pinned}_{self.layout}"


GRID = tuple(Policy(o, layout, p) for layout in LAYOUTS for o in ORDERINGS for p in (False, True))


def named(*names: str) -> tuple[Policy, ...]:
    by_name = {p.name: p for p in GRID}
    return tuple(by_name[n] for n in names)


def random_key(seed: int) -> Column:
    """A uniform number that comment and seed decide, the same in every engine: 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat_ws("-", "comment_id", F.lit(str(seed)))), 1, 13)
    return F.conv(digits, 16, 10).cast("double")


def _ascending(ordering: str) -> Column:
    column, descends = ORDERINGS[ordering]
    value = F.col(column).cast("double")
    return -value if descends else value


def with_keys(df: DataFrame, seed: int = 7) -> DataFrame:
    """The random draw, and each comment's root's row as struct column root_row; null if the root is not there."""
    drawn = df.withColumn("random", random_key(seed))
    columns = sorted({c for c, _ in ORDERINGS.values()}) + ["pinned", "order"]
    tree = Window.partitionBy("article", "root_of_tree")
    # a tree's root is one row of it
    own = F.struct(*[F.col(c) for c in columns])
    return drawn.withColumn("root_row", F.max(F.when(F.col("is_root"), own)).over(tree))


def _keys(p: Policy, compat: bool) -> Column:
    """stratum, place in the pinned stratum, key, tie of roots, own place; nulls sort last."""
    if p.layout == "rt":
        column, descends = ORDERINGS[p.ordering]
        value = F.col(f"root_row.{column}").cast("double")
        key, pinned, place = (-value if descends else value), F.col("root_row.pinned"), F.col("root_row.order")
        tie = -place if p.ordering in REVERSED else place
    else:
        key, pinned, place = _ascending(p.ordering), F.col("pinned"), F.col("order")
        tie = place
    if not p.pinned:
        stratum, first = F.lit(0), F.lit(None).cast("int")
    else:
        late = compat and p.layout == "rt" and p.ordering == "least-neg-abs"
        stratum = F.when(pinned, F.lit(1 if late else 0)).otherwise(F.lit(0 if late else 1))
        first = F.when(pinned, -place if late else place)
        key = F.when(~pinned, -key if late else key)
    return F.struct(F.lit(p.name).alias("policy"), stratum.alias("k0"), first.alias("k1"), key.alias("k2"), tie.alias("k3"))



def sort_keys() -> list[Column]:
    return [F.col(k).asc_nulls_last() for k in ("k0", "k1", "k2", "k3")] + [F.col("order").asc()]


def exploded(df: DataFrame, policies: tuple[Policy, ...] = GRID, seed: int = 7, compat: bool = False) -> DataFrame:
    """A row per comment and policy that shows it, with the policy's sort keys.

    compat: least negative, pinned, trees as a reversed ranking of a
    pinned-first one: pinned trees come last, the most negative others first.
    """
    keyed = with_keys(df, seed)
    always = F.array(*[_keys(p, compat) for p in policies if p.layout != "rh"]) if any(p.layout != "rh" for p in policies) else None
    hidden = F.array(*[_keys(p, compat) for p in policies if p.layout == "rh"]) if any(p.layout == "rh" for p in policies) else None
    shown = [x for x in (always, F.when(F.col("is_root"), hidden).otherwise(F.slice(hidden, 1, 0)) if hidden is not None else None) if x is not None]
    rows = reduce(lambda a, b: F.concat(a, b), shown)
    return keyed.withColumn("_p", F.explode(rows)).select(*[c for c in df.columns], "_p.*")


def positions(df: DataFrame, policies: tuple[Policy, ...] = GRID, seed: int = 7, compat: bool = False) -> DataFrame:
    """(article, policy, position, comment_id) of every ranked comment."""
    rank = Window.partitionBy("article", "policy").orderBy(*sort_keys())
    return exploded(df, policies, seed, compat).withColumn("position", F.row_number().over(rank)).select("article", "policy", "position", "comment_id")


def long_discussions(df: DataFrame, least: int = 100) -> DataFrame:
    """Comments of discussions with more than least comments."""
    return df.withColumn("n", F.count("*").over(Window.partitionBy("article"))).filter(F.col("n") > least)


def parse_name(df: DataFrame, column: str = "policy_name") -> DataFrame:
    """policy, replies, pinned and display key of a policy's name."""
    name = F.col(column)
    policy, replies = F.split_part(name, F.lit("_"), F.lit(1)), F.element_at(F.split(name, "_"), -1)
    pinned = name.contains("pinned")
    return df.withColumns({"policy": policy, "replies": replies, "pinned": pinned.cast("int"), "display": F.concat_ws("_", policy, F.when(pinned, F.lit("pinned")), replies)})
