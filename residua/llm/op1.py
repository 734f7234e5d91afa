"""Query op1_language_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_part, table
from .languages import fit, identify

NAME = "op1_language_id"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc_part(F.col("doc_id"), 4) == 2)
    model = fit(docs.filter(~F.col("held_out")))
    x, _ = identify(docs.select("doc_id", "held_out", "text"), model)
    return x.select("doc_id", "held_out", "lang_pred", "score", "accepted")
