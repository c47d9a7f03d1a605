"""Casts, booleans in their many spellings, missing values and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: German month names and abbreviations by number.
MONTHS = (("jan", "jän"), ("feb",), ("mär", "mar"), ("apr",), ("mai", "may"), ("jun",), ("jul",), ("aug",), ("sep",), ("okt", "oct"), ("nov",), ("dez", "dec"))


def boolean(c: Column) -> Column:
    """0/1, true/false in any case, or a boolean, as a boolean; others null."""
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin("1", "true", "t", "1.0"), True).when(s.isin("0", "false", "f", "0.0"), False)


def integer(c: str) -> Column:
    """Text as an integer; null where it isn't one."""
    return F.expr(f"try_cast({c} as int)")


def filled(df: DataFrame, **constants: float) -> DataFrame:
    """Nulls and NaN of each column replaced by its constant."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(v)) for c, v in constants.items()})


def coalesce_chain(df: DataFrame, *columns: str) -> DataFrame:
    """Each column filled from the one before it, filled already."""
    out = {}
    for k, c in enumerate(columns):
        out[c] = F.coalesce(*[F.col(x) for x in reversed(columns[: k + 1])])
    return df.withColumns(out)


def german_time(c: str) -> Column:
    """"3. Okt. 2022, 14:05:00" (seconds may be left out) as a timestamp without zone; null if it isn't one."""
    day, month, year, clock = (F.regexp_extract(c, r"^\s*(\d{1,2})\.\s*(\p{L}+)\.?\s*(\d{4}),?\s*(\d{1,2}:\d{2}(?::\d{2})?)", k) for k in (1, 2, 3, 4))
    three = F.lower(F.substring(month, 1, 3))
    number = F.lit(None).cast("string")
    for k, names in enumerate(MONTHS, 1):
        number = F.when(three.isin(*names), F.lit(f"{k:02d}")).otherwise(number)
    full = F.when(F.length(clock) <= 5, F.concat(clock, F.lit(":00"))).otherwise(clock)
    return F.try_to_timestamp(F.concat(year, F.lit("-"), number, F.lit("-"), F.lpad(day, 2, "0"), F.lit(" "), F.lpad(full, 8, "0")), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def hours_since(later: str, earlier: str) -> Column:
    """Hours between two times, 0 if they stand the other way."""
    return F.greatest(F.lit(0.0), F.expr(f"timestampdiff(SECOND, {earlier}, {later})") / 3600.0)


def minutes_since_first(ts: str, first: Column, days_dropped: bool = False) -> Column:
    """Minutes after a first time, in seconds since 1970; days_dropped: of whole days only the rest."""
    d = F.col(ts) - first
    return (F.pmod(d, F.lit(86400)) if days_dropped else d) / 60.0


def code(c: str, values: dict[str, int]) -> Column:
    """A value's number; null for values not listed."""
    out = F.lit(None).cast("int")
    for v, k in values.items():
        out = F.when(F.col(c) == v, F.lit(k)).otherwise(out)
    return out


def display(df: DataFrame, c: str, names: dict[str, str], to: str) -> DataFrame:
    """A literal dictionary applied; values not listed keep their own name."""
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return df.withColumn(to, F.coalesce(pairs[F.col(c)], F.col(c)))
