"""Formats of trajectories: each has a reader that gives frames (traj_id, frame, coords), the schema all operators take.

A format of one's own is added with ``register``; its reader gets the session, the path and a limit of frames.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.formation import pack
from ..operators.series import positioned
from .pdb import FRAMES, read_pdb

Reader = Callable[[SparkSession, str, int | None], DataFrame]
_readers: dict[str, Reader] = {}


def register(name: str, reader: Reader) -> None:
    """Add a format, or put another reader in the place of one."""
    _readers[name] = reader


def formats() -> list[str]:
    return sorted(_readers)


def read_frames(spark: SparkSession, path: str, format: str | None = None, max_frames: int | None = None) -> DataFrame:
    """The frames of ``path``; the format is the path's suffix by default, pdb without one."""
    name = format or os.path.splitext(path.rstrip("/"))[1].removeprefix(".").lower() or "pdb"
    if name not in _readers:
        raise ValueError(f"no such format: {name}; there are {', '.join(formats())}")
    x = _readers[name](spark, path, max_frames)
    missing = [c for c in ("traj_id", "frame", "coords") if c not in x.columns]
    if missing:
        raise ValueError(f"the reader of {name} gives no {', '.join(missing)}")
    return x.select("traj_id", "frame", "coords")


def points_reader(source: str, **options: object) -> Reader:
    """A reader of tables with a row a point: frame, residue, x, y, z and, if there is one, traj_id (else the file's path).

    ``source`` is a format of Spark's own readers.  Of points of one residue in a frame that with the largest x, y, z
    counts; rows without a frame, residue or coordinate don't.  ``max_frames`` keeps the lowest frame numbers of each
    trajectory, since a table has no order of its own.
    """

    def read(spark: SparkSession, path: str, max_frames: int | None) -> DataFrame:
        raw = spark.read.format(source).options(**options).load(path)
        need = ["frame", "residue", "x", "y", "z"]
        if missing := [c for c in need if c not in raw.columns]:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        traj = F.col("traj_id") if "traj_id" in raw.columns else F.col("_metadata.file_path").alias("traj_id")
        x = raw.select(traj, *(F.col(c).try_cast("int").alias(c) for c in need[:2]), *(F.col(c).try_cast("double").alias(c) for c in need[2:])).na.drop(subset=need)
        if max_frames is not None:
            own = x.select("traj_id", "frame").distinct()
            x = x.join(positioned(own, ["traj_id"]).filter(F.col("pos") < max_frames).select("traj_id", "frame"), ["traj_id", "frame"], "left_semi")
        point = x.groupBy("traj_id", "frame", "residue").agg(F.max(F.struct("x", "y", "z")).alias("p"))
        return pack(point.select("traj_id", "frame", "residue", "p.x", "p.y", "p.z"))

    return read


register("pdb", read_pdb)
register("parquet", points_reader("parquet"))
register("orc", points_reader("orc"))
register("json", points_reader("json"))
register("csv", points_reader("csv", header=True))

__all__ = ["FRAMES", "formats", "points_reader", "read_frames", "register"]
