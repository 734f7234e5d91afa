"""Datasets behind the plots: contact maps, series, animations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import binary


def contact_map_points(contacts: DataFrame) -> DataFrame:
    """x (= j), y (= i), cluster of the contacts below the diagonal, i < j; one square per row."""
    return contacts.filter("i < j").select(F.col("j").alias("x"), F.col("i").alias("y"), "cluster")


def contact_map_stats(contacts: DataFrame) -> DataFrame:
    """total, clustered, unassigned, below_diagonal, clusters (without 0), max_residue (100 without contacts)."""
    return contacts.agg(
        F.count("*").alias("total"), F.count_if(F.col("cluster") != 0).alias("clustered"), F.count_if(F.col("cluster") == 0).alias("unassigned"), F.count_if(F.col("i") < F.col("j")).alias("below_diagonal"),
        F.countDistinct(F.when(F.col("cluster") != 0, F.col("cluster"))).alias("clusters"), F.coalesce(F.max(F.greatest("i", "j")), F.lit(100)).alias("max_residue"))


def cluster_distribution(contacts: DataFrame) -> DataFrame:
    return contacts.groupBy("cluster").agg(F.count("*").alias("size")).orderBy("cluster")


def trajectory_series(q: DataFrame, clusters: DataFrame, raw_q: DataFrame | None = None, raw_clusters: DataFrame | None = None) -> DataFrame:
    """traj_id, frame, panel (q, cluster), cluster, kind (line, raw), value of both panels; raw ones only if given."""
    one = lambda d, value, panel, kind, cluster: d.select("traj_id", "frame", F.lit(panel).alias("panel"), cluster.alias("cluster"), F.lit(kind).alias("kind"), F.col(value).alias("value"))
    none = F.lit(None).cast("int")
    out = one(q, next(c for c in ("q_smooth", "q") if c in q.columns), "q", "line", none).unionByName(one(clusters, "value", "cluster", "line", F.col("cluster")))
    if raw_q is not None:
        out = out.unionByName(one(raw_q, "q", "q", "raw", none))
    if raw_clusters is not None:
        out = out.unionByName(one(raw_clusters, "value", "cluster", "raw", F.col("cluster")))
    return out


def of_contacts(series: DataFrame, contacts: DataFrame) -> DataFrame:
    """The rows of a series whose cluster the contacts have."""
    return series.join(contacts.select("cluster").distinct(), "cluster", "left_semi")


def summary_series(summary: DataFrame, cutoff: float | None = None) -> DataFrame:
    """traj_id, frame, panel, cluster, kind, value of a summary's lines; with a cutoff as 0 and 1."""
    value = F.col("value") if cutoff is None else binary(F.col("value"), cutoff)
    return summary.select("traj_id", "frame", F.lit("cluster").alias("panel"), "cluster", F.lit("line").alias("kind"), value.alias("value"))


def animation_points(results: DataFrame, contacts: DataFrame) -> DataFrame:
    """traj_id, frame, cluster, x (larger residue), y (smaller one): the contacts of the map that a frame has, orientation apart.

    Every row of the map counts, repeated ones too; contact lists of frames are sets here.
    """
    pair = lambda p: F.struct(F.least(p["i"], p["j"]).alias("a"), F.greatest(p["i"], p["j"]).alias("b"))
    there = results.select("traj_id", "frame", F.explode(F.array_distinct(F.transform("contact_list", pair))).alias("p")).select("traj_id", "frame", "p.a", "p.b")
    own = contacts.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "cluster")
    return there.join(own, ["a", "b"]).select("traj_id", "frame", "cluster", F.col("b").alias("x"), F.col("a").alias("y"))


def animation_titles(results: DataFrame) -> DataFrame:
    """traj_id, frame, title: Frame f | Contacts: n | Q: q to three places."""
    n = F.size(F.array_distinct(F.transform("contact_list", lambda p: F.struct(F.least(p["i"], p["j"]), F.greatest(p["i"], p["j"])))))
    return results.select("traj_id", "frame", F.format_string("Frame %d | Contacts: %d | Q: %.3f", "frame", n, "q").alias("title"))
