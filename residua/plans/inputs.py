"""Trajectories, contact lists and lattices made from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import distance
from ..functions.shipping import shared_folder
from ..sources.files import write_lines

RESIDUES = 21
#: The event types in order of their cluster number are found by name; clusters are 0 to 4.
CLUSTERS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str, only: str = "true") -> DataFrame:
    """``embeddings`` as a trajectory: frame vec_id + 1, residue k at elements 3k - 2 to 3k."""
    at = lambda n: F.get("embedding", n).cast("double")
    points = F.transform(F.sequence(F.lit(0), F.lit(RESIDUES - 1)), lambda k: F.struct(at(3 * k).alias("x"), at(3 * k + 1).alias("y"), at(3 * k + 2).alias("z")))
    coords = F.map_from_arrays(F.sequence(F.lit(1), F.lit(RESIDUES)), points)
    return table(spark, sf_dir, "embeddings").filter(only).select(F.lit("embeddings").alias("traj_id"), (F.col("vec_id") + 1).cast("int").alias("frame"), coords.alias("coords"))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native contacts of frame 1: residues at least three apart, r their distance, cluster (i + j) mod 5."""
    from ..operators.formation import unpack

    one = unpack(frames(spark, sf_dir, "vec_id = 0")).select("residue", F.struct("x", "y", "z").alias("p"))
    a, b = one.select(F.col("residue").alias("i"), F.col("p").alias("a")), one.select(F.col("residue").alias("j"), F.col("p").alias("b"))
    x = a.join(F.broadcast(b), F.col("j") >= F.col("i") + 3)  # 21 rows
    return x.select((F.col("i") * 1000 + F.col("j")).cast("bigint").alias("ord"), "i", "j", distance(F.col("a"), F.col("b")).alias("r"), ((F.col("i") + F.col("j")) % CLUSTERS).cast("int").alias("cluster"))


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as contacts: cells of supplier and part that over 20 lines share; ord by i, j."""
    x = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 60 + 1).cast("int").alias("i"), (F.col("l_partkey") % 60 + 64).cast("int").alias("j"))
    x = x.groupBy("i", "j").agg(F.count("*").alias("lines")).filter("lines >= 21")
    return x.select(F.lit("lineitem").alias("map_id"), (F.col("i") * 1000 + F.col("j")).cast("bigint").alias("ord"), "i", "j")


def events_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as many trajectories: one per user, frames in order of time, cluster by event type, n = floor(100 * value) of 100."""
    x = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    frame = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    kind = F.pmod(F.length("event_type"), F.lit(CLUSTERS))
    return x.select(F.col("user_id").alias("traj_id"), frame.cast("int").alias("frame"), kind.cast("int").alias("cluster"), F.floor(F.col("value") * 100).cast("bigint").alias("n"), F.lit(100).cast("bigint").alias("size"))


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the folder that all executors share."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def pdb_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, value: the trajectory's models as PDB text, one a row; made by as many tasks as the session shuffles with."""
    x = frames(spark, sf_dir).select("frame", F.map_entries("coords").alias("points")).repartition("frame")
    atom = F.transform("points", lambda p: F.format_string("ATOM  %5d  CA  ALA A%4d    %8.3f%8.3f%8.3f  1.00  0.00           C", p["key"], p["key"], p["value"]["x"], p["value"]["y"], p["value"]["z"]))
    return x.select("frame", F.concat(F.format_string("MODEL     %4d\n", "frame"), F.array_join(atom, "\n"), F.lit("\nENDMDL")).alias("value"))


def pdb_file(spark: SparkSession, sf_dir: str, path: str) -> str:
    """The trajectory as one PDB file, its models by their numbers; its path."""
    write_lines(pdb_lines(spark, sf_dir).orderBy("frame").select("value"), path)
    return path


def pdb_text(spark: SparkSession, sf_dir: str, files: int | None = None) -> str:
    """The trajectory as PDB files in a new folder, a model per row; its path."""
    path = new_folder(spark, "pdb")
    if files == 1:
        pdb_file(spark, sf_dir, f"{path}/t.pdb")
        return path
    lines = pdb_lines(spark, sf_dir)
    lines = lines.orderBy("frame").coalesce(files).sortWithinPartitions("frame") if files else lines
    lines.select("value").write.text(path)
    return path
