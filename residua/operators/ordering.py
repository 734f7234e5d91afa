"""In which order clusters form, from a binary summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_index(summary: DataFrame) -> DataFrame:
    """A summary read from text with widx: the place of each window by frame."""
    rank = F.dense_rank().over(W.partitionBy("traj_id").orderBy("frame")) - 1
    return summary.withColumn("widx", rank.cast("bigint"))


def start_window(summary: DataFrame) -> DataFrame:
    """traj_id, start: the first window with all clusters but 0 formed, else the first with most; null if none ever forms."""
    x = summary.filter("cluster <> 0")
    counts = x.groupBy("traj_id", "widx").agg(F.count_if(F.col("value") >= 1.0).alias("c"), F.count("*").alias("k"))
    per = W.partitionBy("traj_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    counts = counts.withColumns({"k": F.max("k").over(per), "most": F.max("c").over(per)})
    all_, most = F.min(F.when(F.col("c") == F.col("k"), F.col("widx"))), F.min(F.when((F.col("c") == F.col("most")) & (F.col("c") > 0), F.col("widx")))
    return counts.groupBy("traj_id").agg(F.coalesce(all_, most).alias("start"))


def formation_order(summary: DataFrame, strict: bool = True) -> DataFrame:
    """traj_id, rank (from 1), cluster: by the last time each cluster forms up to the start window, earliest first.

    A cluster that is formed from the first window on and never forms anew comes as formed at 0; one that isn't formed by
    the start is left out; of clusters that form together the higher number comes first.  Cluster 0 never counts.  With
    ``strict`` a trajectory in which none ever forms raises, else it has no rows.
    """
    x = summary.filter("cluster <> 0").select("traj_id", "widx", "cluster", (F.col("value") >= 1.0).alias("f"))
    start = start_window(summary)
    if strict:
        start = start.withColumn("start", F.coalesce("start", F.raise_error(F.concat(F.lit("no cluster ever forms in "), F.col("traj_id").cast("string"))).cast("bigint")))
    x = x.withColumn("before", F.lag("f").over(W.partitionBy("traj_id", "cluster").orderBy("widx"))).join(start, "traj_id")
    edge = F.max(F.when(F.col("f") & ~F.col("before") & (F.col("widx") <= F.col("start")), F.col("widx")))
    x = x.groupBy("traj_id", "cluster").agg(edge.alias("e"), F.max(F.when(F.col("widx") == 0, F.col("f"))).alias("f0")).filter("e is not null or f0")
    rank = F.row_number().over(W.partitionBy("traj_id").orderBy(F.coalesce("e", F.lit(0)), F.col("cluster").desc()))
    return x.select("traj_id", rank.cast("int").alias("rank"), "cluster")


def order_text(order: DataFrame) -> DataFrame:
    """traj_id, formation: the clusters joined by commas, first formed first."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "cluster")))
    return order.groupBy("traj_id").agg(F.array_join(F.transform(ranked, lambda r: r["cluster"].cast("string")), ",").alias("formation"))
