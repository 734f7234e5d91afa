"""Query op6_sentencepiece."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .sentencepieces import Vocabulary, roundtrip

NAME = "op6_sentencepiece"


def model_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return roundtrip(table(spark, sf_dir, "documents"), Vocabulary.read(path or model_path()))
