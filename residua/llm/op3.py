"""Query op3_license_scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .licenses import scan_licenses

NAME = "op3_license_scan"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    x, _ = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return x.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
