"""Helpers shared by the operators: inputs, unique names, shared storage, hot-key joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A key with more than 1/HOT_SHARE of all rows is hot; there are fewer than HOT_SHARE such keys.
HOT_SHARE = 1024
#: Classes that a sample for learning has at most.
CLASSES = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session that names none gets one of its own, on a cluster that is an error."""
    if spark.sparkContext.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp(prefix="residua-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: cuts lineage and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` made of these frames; nothing may read them any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, total: int | None = None) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row per key and in ``weight`` the number of left rows with it.

    Keys with over 1/HOT_SHARE of the left rows are fewer than HOT_SHARE, so that part of ``right`` has a proven
    bound and is broadcast; the others go through an ordinary shuffled join and are small by definition.  ``total`` is
    the sum of the weights, if known.
    """
    if total is None:
        total = right.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("t")).first()["t"]
    limit = max(1000, total // HOT_SHARE)
    hot = right.filter(F.col(weight) > limit)
    cold = right.filter(F.col(weight) <= limit)
    marks = F.broadcast(hot.select(key))
    return left.join(F.broadcast(hot), key).unionByName(left.join(marks, key, "left_anti").join(cold, key))


def crc_part(column: Column, parts: int) -> Column:
    """crc32 of the value as text, mod ``parts``; null as an empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit(""))), F.lit(parts))


def bounded_sample(df: DataFrame, by: str, keys: list[str], most: int, classes: int = CLASSES) -> DataFrame:
    """``most`` different rows, by ``keys``, for each value of ``by`` but null (all, where there are fewer): those with the smallest hashes, the same on each run.

    ``keys`` are what tells rows apart, null or repeated ones too; of equal rows one counts.  Of more than ``classes``
    values of ``by`` the most frequent ones have a sample, so it never has more than ``classes * most`` rows.  Two scans,
    whatever the number of values: narrow ones of hashes, then one for the rows that were chosen.

    Hashes are spread evenly, so of a value's n rows about 4 * most + 200 lie in that share of the hashes' range from
    below; only these are ranked.  That fewer than ``most`` do has a probability below 1e-60.
    """
    own = [c for c in df.columns]
    value, hash_, place = fresh(df, "sampled_by", "sampled_hash", "sampled_place")
    rows = df.filter(col(by).isNotNull()).withColumn(value, col(by)).withColumn(hash_, F.xxhash64(*map(col, keys)))
    narrow = rows.select(value, hash_).distinct()
    top = narrow.groupBy(value).count().orderBy(F.col("count").desc(), value).limit(classes)
    low = F.col(hash_).cast("double") <= ((4 * most + 200) / F.col("count") - 0.5) * 2.0**64
    ranked = narrow.join(F.broadcast(top), value).filter(low).drop("count").withColumn(place, F.row_number().over(W.partitionBy(value).orderBy(hash_)))
    chosen = ranked.filter(F.col(place) <= most).drop(place)
    return rows.join(F.broadcast(chosen), [value, hash_], "left_semi").dropDuplicates([value, hash_]).select(*map(col, own))
