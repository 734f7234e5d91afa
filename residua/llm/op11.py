"""Query op11_secret_scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .secretscan import scan_secrets

NAME = "op11_secret_scan"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess, most_bits of every document."""
    x, names = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = F.col(names["secrets"])
    of = lambda kind: F.filter(found, lambda s: s["kind"] == kind)
    count = lambda kind: F.size(of(kind)).cast("bigint").alias(f"n_{kind}")

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = text(F.filter(found, lambda s: s["kind"] != "guess"))
    bits = F.array_max(F.transform(of("guess"), lambda s: s["bits"]))
    return x.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), text(found).alias("spans"), count("guess"), F.round(bits, 6).alias("most_bits"))
