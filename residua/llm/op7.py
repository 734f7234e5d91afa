"""Query op7_quality_rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .rules import verdicts

NAME = "op7_quality_rules"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    x, _ = verdicts(docs, table(spark, sf_dir, "labels"))
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")
