"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every text is measured once and every rule decided once. The ledger holds the
measurements and the failures as bits of one long. A policy is a version and a
mask of the rules that it enforces, so another policy, or the effect of leaving
out one rule, is bit arithmetic over the ledger and never reads a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import materialise, renamed

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]"

#: Rules by bit, from 0 on: name and the condition on the measurements that fails it.
#: The first two are the base rules; sums are compared, so that no rule divides.
RULES = (
    ("too_few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("short_words", "n_words > 0 and word_chars < 2 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("upper_case", "n_letters > 0 and 100 * n_upper > 60 * n_letters"),
    ("no_letters", "n_words > 0 and 2 * n_letters < word_chars"),
)


@dataclass(frozen=True)
class Policy:
    """A version and the rules, by name, that reject a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [n for n, _ in RULES]
        return sum(1 << names.index(r) for r in self.rules)


#: Versions of the policy; a later one replaces an earlier one without reading a text again.
BASE = Policy("base", ("too_few_words", "repeated_windows"))
STRICT = Policy("v1", tuple(n for n, _ in RULES))
PLAIN = Policy("v2", tuple(n for n, _ in RULES if n not in ("upper_case", "no_letters")))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for all uses inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more, first included.

    Windows are compared by their 64-bit hash. Sorted (hash, place) pairs put
    equal windows side by side; the places found, in order, cover three words
    each less their overlap. All inside one row: n log n, and no exchange.
    """
    windows = F.slice(F.transform(words, lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p"))), 1, F.greatest(F.lit(0), F.size(words) - 2))

    def cover(places: Column) -> Column:
        gaps = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def found(s: Column) -> Column:
        def same(k: Column, x: Column) -> Column:
            return F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))

        again = F.filter(s, lambda x, k: F.when(k > 0, same(k - 1, x)).otherwise(F.lit(False)) | same(k + 1, x))
        return _let(F.sort_array(F.transform(again, lambda x: x["p"])), cover)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(F.sort_array(windows), found)).cast("long")


def _measures(text: Column) -> Column:
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    letters = F.regexp_replace(text, r"[^\p{L}]+", "")

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
            repeat_words(w).alias("n_repeat_words"),
        )

    return F.struct(
        _let(words, of).alias("w"),
        F.char_length(F.regexp_replace(text, SYMBOLS + "+", "")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        _let(letters, lambda x: F.struct(F.char_length(x).cast("long").alias("n_letters"), F.char_length(F.regexp_replace(x, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"))).alias("c"),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper")


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, MEASURES (long) and fail_bits (long) of every row.

    A null text is empty: no words, lines or letters. Rows are measured alone,
    so repeated rows and null ids are as any other; texts of any length are measured whole. Columns other than
    text and those kept are ignored, whatever their names. An empty table gives no
    rows.
    """
    rows = renamed(docs, *keep, "text") if "text" not in keep else renamed(docs, *keep)
    found = rows.select(*[F.col(f"`{c}`") for c in keep], _let(F.coalesce("text", F.lit("")), _measures).alias("_m"))
    flat = found.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"_m.{p}{m}").alias(m) for p, m in zip(("w.", "w.", "", "l.", "l.", "w.", "c.", "c."), MEASURES, strict=True)])
    bits = [F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, condition) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return flat.withColumn("fail_bits", total)


def stored(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ledger as a written table: what policies and ablations read, so that each text is measured once."""
    return materialise(ledger(docs, keep), "rules-ledger")


def passes(policy: Policy) -> Column:
    """Whether a row of the ledger fails none of the policy's rules."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply(book: DataFrame, *policies: Policy) -> DataFrame:
    """The ledger with a column kept_<version> for each policy."""
    return book.withColumns({f"kept_{p.version}": passes(p) for p in policies})


def alone(policy: Policy) -> Column:
    """The name of the policy's rule that alone rejects a row; null if none or several do."""
    bits = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    return F.coalesce(*[F.when(bits == (1 << k), n) for k, (n, _) in enumerate(RULES)])


def ablation(book: DataFrame, policy: Policy) -> DataFrame:
    """(rule, failed, failed_alone): rows that a rule fails, and those that only it rejects.

    The ledger is first counted by its masked bits, at most 2^rules rows made
    before any exchange; failed_alone is what leaving the rule out would keep.
    """
    counts = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, (n, _) in enumerate(RULES) if n in policy.rules])
    each = counts.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"), F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone"))
