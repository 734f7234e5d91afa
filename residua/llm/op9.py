"""Query op9_quality_classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .classifier import Network, fit, scored
from .common import crc_part, table

NAME = "op9_quality_classifier"


def learned(docs: DataFrame, labels: DataFrame) -> Network:
    """From the labelled rows that are not held out."""
    return fit(docs, labels.filter(crc_part(F.col("doc_id"), 3) != 1))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = learned(docs, table(spark, sf_dir, "labels"))
    x, _ = scored(docs.withColumn("held_out", crc_part(F.col("doc_id"), 3) == 1), net)
    return x.select("doc_id", "held_out", "score", "predicted")
