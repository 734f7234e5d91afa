"""Column expressions: distances, predicates, text forms of numbers, lists and maps."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """``df``, computed once while the block runs, on disk if need be; one that is kept already stays so."""
    level = df.storageLevel
    if level.useMemory or level.useDisk:
        yield df
        return
    df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row, however many expressions and lambdas use them after."""
    names = list(columns)
    made = F.struct(*(columns[n].alias(n) for n in names))
    return df.withColumn("_once", F.explode(F.array(made))).select("*", *(F.col(f"_once.{n}").alias(n) for n in names)).drop("_once")


def native_distance(r6: Column, r12: Column) -> Column:
    """10 * sqrt(6/5 * r12 / r6), the minimum of the 10-12 potential in angstroms; infinite for r6 = 0 and r12 > 0, else null where undefined."""
    ratio = r12 / F.nullif(r6, F.lit(0.0))
    return F.when((r6 == 0) & (r12 > 0), F.lit(float("inf"))).when(ratio >= 0, 10 * F.sqrt(F.lit(1.2) * ratio))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two points, squares summed in the order x, y, z."""
    d = [a[c] - b[c] for c in "xyz"]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def is_formed(d: Column, r: Column, cutoff: float) -> Column:
    """Strictly nearer than cutoff * r. Spark orders NaN above all numbers, so a NaN r needs its own test."""
    return F.coalesce((d < r * F.lit(float(cutoff))) & ~F.isnan(r), F.lit(False))


def binary(value: Column, cutoff: float) -> Column:
    return F.when(value >= F.lit(float(cutoff)), F.lit(1.0)).otherwise(F.lit(0.0))


def number_text(x: Column) -> Column:
    """Shortest round-trip text without exponent: 1.0 as 1, 1.0E-7 as 0.0000001."""
    s = x.cast("string")
    return F.when(~s.contains("E"), F.regexp_replace(s, r"\.0$", "")).otherwise(F.get(F.transform(F.array(s), _without_exponent), 0))  # a lambda, so that compiled code has none of the rare case


def _without_exponent(s: Column) -> Column:
    sign = F.when(s.startswith("-"), "-").otherwise("")
    body = F.regexp_replace(s, "^-", "")
    mantissa = F.regexp_replace(F.split_part(body, F.lit("E"), F.lit(1)), r"\.0$", "")
    whole, part = F.split_part(mantissa, F.lit("."), F.lit(1)), F.split_part(mantissa, F.lit("."), F.lit(2))
    e = F.split_part(body, F.lit("E"), F.lit(2)).try_cast("int")
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), whole, part)
    digits = F.rpad(F.concat(whole, part), F.length(whole) + e, "0")
    tail = F.substring(F.concat(whole, part), F.length(whole) + e + 1, F.length(part))
    large = F.concat(digits.substr(F.lit(1), F.length(whole) + e), F.when(F.length(part) > e, F.concat(F.lit("."), tail)).otherwise(""))
    return F.concat(sign, F.when(e < 0, small).otherwise(large))


def list_text(pairs: Column) -> Column:
    """[(1, 4), (2, 5)]"""
    return F.concat(F.lit("["), F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("("), p["i"].cast("string"), F.lit(", "), p["j"].cast("string"), F.lit(")"))), ", "), F.lit("]"))


def map_text(values: Column) -> Column:
    """{0: 0.5, 1: 1}, by ascending key."""
    entries = F.array_sort(F.map_entries(values))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(e["key"].cast("string"), F.lit(": "), number_text(e["value"]))), ", "), F.lit("}"))


def parse_list(text: Column) -> Column:
    """The pairs of [(1, 4), (2, 5)]."""
    found = F.regexp_extract_all(text, F.lit(r"(\(\s*-?\d+\s*,\s*-?\d+\s*\))"), F.lit(1))
    part = lambda p, k: F.regexp_extract(p, r"\(\s*(-?\d+)\s*,\s*(-?\d+)\s*\)", k).cast("int")
    return F.transform(found, lambda p: F.struct(part(p, 1).alias("i"), part(p, 2).alias("j")))


def parse_map(text: Column) -> Column:
    """The map of {0: 0.5, 1: 1}; empty pairs are skipped, missing braces or a pair without exactly one colon raise."""
    body = F.trim(text)
    pairs = F.filter(F.transform(F.split(F.substring(body, F.lit(2), F.length(body) - 2), ","), lambda v: F.trim(v)), lambda p: p != "")
    key = lambda p: strict_int(F.regexp_replace(p, ":.*", ""))
    value = lambda p: strict_double(F.regexp_replace(p, "^[^:]*:", ""))
    bad = ~(body.startswith("{") & body.endswith("}")) | F.exists(pairs, lambda p: (F.size(F.split(p, ":")) != 2) | key(p).isNull() | value(p).isNull())
    entries = F.transform(pairs, lambda p: F.struct(key(p).alias("k"), value(p).alias("v")))
    return F.when(bad, F.raise_error(F.concat(F.lit("not a map of numbers: "), text))).otherwise(F.map_from_entries(entries))


def strict_double(text: Column) -> Column:
    """A number as the text says, null if it says none; Java's suffixes d and f are no numbers here."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[^fFdD]*$") | F.lower(t).rlike(r"^[+-]?(inf|infinity|nan)$"), t.try_cast("double"))


def strict_int(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("int"))
