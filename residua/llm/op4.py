"""Query op4_fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .fingerprints import fingerprints

NAME = "op4_fingerprints"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    return fingerprints(table(spark, sf_dir, "documents"))
