"""Drawn lines cover what all points would."""

import random

from pyspark.sql import functions as F

from residua.plans import figures

SCHEMA = "panel string, cluster int, kind string, frame int, value double"


def test_outline_has_every_peak(spark):
    rng = random.Random(7)
    rows = [("cluster", c, "line", f, rng.random() if rng.random() < 0.99 else 5.0 * c) for c in (1, 2) for f in range(100, 4100)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = figures.outlined(df, 50).collect()
    assert len(got) <= 2 * 4 * 50
    step = (4099 - 100) // 50 + 1
    for c in (1, 2):
        for k in range(50):
            whole = [(r[3], r[4]) for r in rows if r[1] == c and (r[3] - 100) // step == k]
            own = [(r["frame"], r["value"]) for r in got if r["cluster"] == c and (r["frame"] - 100) // step == k]
            assert set(own) <= set(whole) and len(own) == len(set(own)) <= 4
            if whole:
                assert {min(whole), max(whole)} <= set(own)
                assert (min(v for _, v in own), max(v for _, v in own)) == (min(v for _, v in whole), max(v for _, v in whole))


def test_few_rows_and_none(spark, tmp_path):
    rows = [("q", None, "line", f, f / 10) for f in range(7)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r["frame"], r["value"]) for r in figures.outlined(df).collect()) == [(f, v) for *_, f, v in rows]
    assert figures.outlined(df.limit(0)).collect() == []
    peak = spark.range(5000).select(F.lit("q").alias("panel"), F.lit(None).cast("int").alias("cluster"), F.lit("line").alias("kind"), F.col("id").cast("int").alias("frame"), F.when(F.col("id") == 2345, 1.0).otherwise(0.0).alias("value"))
    text = open(figures.lines(peak, str(tmp_path / "a.svg"), "t")).read()
    flat = open(figures.lines(peak.withColumn("value", F.lit(0.0)), str(tmp_path / "b.svg"), "t")).read()
    assert text != flat and text.count(",") > flat.count(",") - 10
