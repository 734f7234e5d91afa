"""Readers of contact lists and of the engine's own text results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import native_distance, parse_list, parse_map, strict_double, strict_int


def _ordered(df: DataFrame) -> DataFrame:
    """``ord``: the place of a row in its file. Contact files are small: one per map, 10^2 to 10^3 rows."""
    from pyspark.sql import Window as W

    at = df.select("*", F.col("_metadata.file_path").alias("map_id"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"))
    return at.withColumn("ord", F.row_number().over(W.partitionBy("map_id").orderBy("at", "k")).cast("bigint")).drop("at", "k")


def read_contacts_raw(spark: SparkSession, path: str) -> DataFrame:
    """map_id, ord, i, j, r6, r12, r of a whitespace-separated list without header; the first four columns count.

    r6 = 0 gives an infinite r; a ratio that is negative or undefined raises, since no later step could use it.
    """
    x = _ordered(spark.read.text(path)).withColumn("f", F.split(F.trim("value"), r"\s+")).filter(F.trim("value") != "")
    r6, r12 = strict_double(F.get("f", F.lit(2))), strict_double(F.get("f", F.lit(3)))
    x = x.select("map_id", "ord", strict_int(F.get("f", F.lit(0))).alias("i"), strict_int(F.get("f", F.lit(1))).alias("j"), r6.alias("r6"), r12.alias("r12"), "value")
    r = F.coalesce(native_distance(F.col("r6"), F.col("r12")), F.raise_error(F.concat(F.lit("no native distance: "), F.col("value"))).cast("double"))
    return x.withColumn("r", r).drop("value")


def require_columns(df: DataFrame, names: tuple[str, ...]) -> None:
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """map_id, ord, i, j, r, cluster, with r6 and r12 if there, of a CSV with header; columns by name, bad rows raise."""
    raw = spark.read.option("header", True).csv(path)
    require_columns(raw, ("i", "j", "r", "cluster"))
    x = _ordered(raw)
    line = F.concat_ws(",", *(F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in raw.columns))
    must = lambda c, name: F.coalesce(c, F.raise_error(F.concat(F.lit(f"bad {name} in contact: "), line)).cast("double" if name == "r" else "int")).alias(name)
    more = [strict_double(F.col(c)).alias(c) for c in ("r6", "r12") if c in raw.columns]
    return x.select("map_id", "ord", must(strict_int(F.col("i")), "i"), must(strict_int(F.col("j")), "j"), *more, must(strict_double(F.col("r")), "r"), must(strict_int(F.col("cluster")), "cluster"))


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    """traj_id, frame, contacts, q, contact_list, clusters_filling of a parsed CSV, columns by position."""
    x = spark.read.option("header", True).option("escape", '"').csv(path)
    x = x.select(F.col("_metadata.file_path").alias("traj_id"), *(F.col(f"`{c}`").alias(n) for c, n in zip(x.columns, ("frame", "contacts", "q", "list", "fill"), strict=False)))
    return x.select("traj_id", strict_int(F.col("frame")).alias("frame"), F.trim("contacts").cast("bigint").alias("contacts"), strict_double(F.col("q")).alias("q"), parse_list(F.col("list")).alias("contact_list"), parse_map(F.col("fill")).alias("clusters_filling"))


def _long(spark: SparkSession, path: str, pattern: str, others: tuple[str, ...]) -> DataFrame:
    x = spark.read.option("header", True).csv(path)
    require_columns(x, ("frame", *others))
    found = sorted((int(m[1]), c) for c in x.columns if (m := re.fullmatch(pattern, c)))
    at = [F.col("_metadata.file_path").alias("traj_id"), strict_int(F.col("frame")).alias("frame"), *(strict_double(F.col(c)).alias(c) for c in others)]
    values = F.array(*(F.struct(F.lit(n).alias("cluster"), F.coalesce(strict_double(F.col(c)), F.lit(0.0)).alias("value")) for n, c in found)) if found else F.expr("cast(array() as array<struct<cluster:int,value:double>>)")
    return x.select(*at, F.inline(values))


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """traj_id, frame, cluster, value of the cluster_<n> columns of a summary CSV; other columns are ignored."""
    return _long(spark, path, r"cluster_([+-]?\d+)", ())


def read_smoothed(spark: SparkSession, path: str) -> DataFrame:
    """traj_id, frame, q_smooth, cluster, value of a smoothed CSV."""
    return _long(spark, path, r"cluster_([+-]?\d+)_smooth", ("q_smooth",))
