"""How much of a conversation's opening its turns hold on to: contact analysis of text trajectories.

A conversation is a trajectory, its turns are the frames.  Native contacts are the neighbouring words of the opening
turn; in a turn a contact is formed if both its words are there, as a residue contact is if both residues are near.  The
opening's four quarters are the contact clusters.  From there on all is as for structures: filling per turn and quarter,
running means, means of windows, and the order in which the quarters form.  Words are runs of other than ASCII spaces,
A-Z lower-cased.

    turns/bucket=…/    conv_id, turn, cluster, n of size contacts formed, smoothed
    windows/bucket=…/  conv_id, widx, turn (the window's first), cluster, value
    orders/bucket=…/   conv_id, rank, cluster

Each run writes all of them anew, so that it can be repeated.

    python -m jobs.turn_contacts --config jobs/turn_contacts.toml --conversations <path> --output <folder>
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from residua.operators.ordering import formation_order
from residua.operators.series import smooth, summarize

log = logging.getLogger(__name__)

QUARTERS = 4


def words_of(text: Column) -> Column:
    """The words of a text, in order; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def native_contacts(turns: DataFrame) -> DataFrame:
    """conv_id, a, b, cluster (1 to 4): neighbouring words of each conversation's first turn; of several first turns the smallest text's."""
    first = turns.groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("first")).select("conv_id", words_of(F.col("first.text")).alias("w"))
    first = first.withColumn("n", F.size("w") - 1).filter("n > 0")
    pair = lambda k: F.struct(F.get("w", k).alias("a"), F.get("w", k + 1).alias("b"), (1 + F.floor(QUARTERS * k / F.col("n"))).cast("int").alias("cluster"))
    return first.select("conv_id", F.inline(F.transform(F.sequence(F.lit(0), F.col("n") - 1), pair)))


def turn_fill(conversations: DataFrame) -> DataFrame:
    """traj_id (conversation), frame (turn), cluster, n, size: contacts formed in each turn; rows of one turn count as one text.

    Rows without a conversation or a number are left out; conversations that open with fewer than two words have no contacts.
    """
    turns = conversations.filter("conv_id is not null and turn is not null").select("conv_id", "turn", "text")
    contacts = native_contacts(turns)
    words = turns.select("conv_id", "turn", F.explode(F.array_distinct(words_of(F.col("text")))).alias("w")).distinct()
    pairs = contacts.groupBy("conv_id", "a", "b", "cluster").agg(F.count("*").alias("times"))  # repeated contacts count as often, but meet turns once
    near = pairs.join(words.withColumnRenamed("w", "a"), ["conv_id", "a"]).join(words.withColumnRenamed("w", "b"), ["conv_id", "turn", "b"])
    hits = near.groupBy("conv_id", "turn", "cluster").agg(F.sum("times").alias("n"))
    sizes = contacts.groupBy("conv_id", "cluster").agg(F.count("*").alias("size"))  # four rows at most
    every = turns.select("conv_id", "turn").distinct().join(sizes, "conv_id")
    x = every.join(hits, ["conv_id", "turn", "cluster"], "left")
    return x.select(F.col("conv_id").alias("traj_id"), F.col("turn").cast("int").alias("frame"), "cluster", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "size")


def turn_contacts(spark: SparkSession, conversations: str, output: str, smooth_window: int = 2, window_size: int = 2, cutoff: float = 0.25, buckets: int = 16) -> dict[str, int]:
    """Write turns, windows and orders; returns and logs how many rows were read and written."""
    source = spark.read.parquet(conversations).select("conv_id", "turn", "text")
    done = {"read": source.count()}
    log.info("read %d rows of %s", done["read"], conversations)

    def write(df: DataFrame, name: str) -> DataFrame:
        written = Observation()
        x = df.withColumnRenamed("traj_id", "conv_id").withColumn("bucket", F.pmod(F.xxhash64("conv_id"), F.lit(buckets)).cast("int"))
        path = f"{output}/{name}"
        x.observe(written, F.count("*").alias("rows")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        done[name] = written.get["rows"]
        log.info("wrote %d rows to %s", done[name], path)
        return spark.read.schema(x.schema).parquet(path).withColumnRenamed("conv_id", "traj_id")

    fill = turn_fill(source)
    turns = smooth(fill, smooth_window).withColumnRenamed("value", "smoothed").join(fill, ["traj_id", "frame", "cluster"])
    turns = write(turns.select("traj_id", F.col("frame").alias("turn"), "cluster", "n", "size", "smoothed"), "turns")
    kept = turns.select("traj_id", F.col("turn").alias("frame"), "cluster", "n", "size")
    write(summarize(kept, window_size).select("traj_id", "widx", F.col("frame").alias("turn"), "cluster", "value"), "windows")
    write(formation_order(summarize(kept, window_size, cutoff), strict=False), "orders")
    return done


if __name__ == "__main__":
    from .common import main

    main(turn_contacts, __doc__)
