"""A training-data pipeline: quality classifier, line dedup, near-dedup, mixing, tokenizing.

Each stage takes the documents its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm.classifier import scored
from residua.llm.common import discard, table, written
from residua.llm.lines import dedup_lines
from residua.llm.mixing import mixed
from residua.llm.neardups import deduplicated
from residua.llm.op6 import model_path
from residua.llm.op9 import learned
from residua.llm.sentencepieces import Vocabulary, roundtrip


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among them, rejects go.

    Null and empty texts have one score and go or stay together; a text counts whole, however long; rows without an id
    are scored, but have no label; repeated rows go or stay alike; without labels of both kinds all stay.
    """
    net = learned(docs, table(spark, sf_dir, "labels"))
    x, names = scored(docs, net)
    return x.filter(F.col(names["predicted"]) == 1).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents go; n_chars follows the text.

    All documents stay: a null text stays null, one without other lines gets empty.  Rows are documents, repeated ones
    and ones without an id, too.
    """
    x, names = dedup_lines(docs, min_docs=10)
    text = F.col(names["kept_text"])
    return x.select(*(text.alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, similarity 0.8 or more) stays: that with the smallest id.

    Null and empty texts are linked with nothing and stay.  Rows that repeat a kept id and its text stay with it; of a
    group without any id all rows stay, since they can't be told apart.
    """
    return deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, a row per pass, in training order.

    Texts without words, null ones among them, are never taken.  A null source is a source; rows with one id, or none,
    follow each other by size and text.
    """
    return mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of the mix.

    Null texts are empty ones; repeated rows give repeated results; no text is too long.
    """
    return roundtrip(docs, Vocabulary.read(model_path()))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: SQL can't express the learned classifier nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet in the shared folder and read again; the tables before the last are deleted.

    Columns that the operators add are named apart from those of ``documents``, whatever these are.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
