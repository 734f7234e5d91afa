"""Query op12_periodic_runs."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .periods import periodic_runs

NAME = "op12_periodic_runs"


def repeat(doc_id: int | None, words: list) -> list:
    """A tenth of the texts, by a hash of the id, gets a period from some word on; rows without an id stay as they are."""
    n = len(words)
    if doc_id is None or not n or (h := crc32(str(doc_id).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli of the longest run, runs_sha256, collapsed_sha256 of every document."""
    x, names = periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), edit=(["doc_id"], repeat))
    runs = F.col(names["runs"])
    order = F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))
    lines = F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    top = F.array_min(order)
    length = -top["l"]
    return x.select("doc_id", F.size(runs).cast("bigint").alias("n_runs"), top["start"].alias("start"), length.alias("length"), top["period"].alias("period"),
                    F.floor(1000 * length / top["period"]).cast("bigint").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col(names["collapsed_text"]), 256).alias("collapsed_sha256"))
