"""The two jobs on copies of the given tables, on growing input, and on small rows by hand."""

import os
import random

import pytest
from pyspark.sql import functions as F

from jobs.common import main
from jobs.follow_windows import follow_windows, tables
from jobs.turn_contacts import native_contacts, turn_contacts, turn_fill
from residua.operators.ordering import formation_order

SF = "/root/testdata/sf0.001"
EVENTS = "event_id bigint, user_id bigint, event_type string, value double"


def content(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


def files(path):
    return {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def expected_windows(rows, size):
    """traj_id, cluster, widx, frame, value of the full windows of rows (event_id, user_id, event_type, value), in their order."""
    series, out = {}, []
    for e, u, kind, v in rows:
        if e is not None and u is not None:
            series.setdefault((u, len(kind) % 5 if kind is not None else 0), []).append((e, int(v * 100 // 1) if v is not None else 0))
    for (u, c), own in series.items():
        for w in range(len(own) // size):
            part = own[w * size : (w + 1) * size]
            out.append((u, c, w, min(e for e, _ in part), sum(n for _, n in part) / (100 * size)))
    return sorted(map(repr, out))


def test_follow_windows_takes_only_what_is_new(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("events", "out", "checkpoint"))
    table = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "event_type", "value")
    half = table.count() // 2
    table.filter(F.col("event_id") < half).coalesce(1).write.parquet(src)
    first = follow_windows(spark, src, out, mark, window_size=3)
    assert first["events"] == table.filter(F.col("event_id") < half).count() and first["batches"] >= 1
    before = content(tables(spark, out)[0])
    table.filter(F.col("event_id") >= half).coalesce(1).write.mode("append").parquet(src)
    second = follow_windows(spark, src, out, mark, window_size=3)
    assert second["events"] == table.filter(F.col("event_id") >= half).count()
    windows, orders = tables(spark, out)
    assert set(before) < set(content(windows)) and windows.count() == first["windows"] + second["windows"]
    rows = [tuple(r) for r in table.orderBy("event_id").collect()]
    assert sorted(map(repr, (tuple(r) for r in windows.select("traj_id", "cluster", "widx", "frame", "value").collect()))) == expected_windows(rows, 3)
    want = formation_order(windows.withColumn("value", F.when(F.col("value") >= 62.0, 1.0).otherwise(0.0)), strict=False)
    assert content(orders.drop("bucket")) == content(want) and orders.count() == second["orders"] > 0

    stood, whole = files(out), content(windows) + content(orders)
    third = follow_windows(spark, src, out, mark, window_size=3)  # nothing is new
    assert third["events"] == third["windows"] == third["batches"] == 0 and third["orders"] == second["orders"]
    again = tables(spark, out)
    assert content(again[0]) + content(again[1]) == whole and files(out) == stood

    once = str(tmp_path / "once")
    follow_windows(spark, src, once, str(tmp_path / "other"), window_size=3)  # all at one time
    assert content(tables(spark, once)[0].drop("batch")) == content(again[0].drop("batch")) and content(tables(spark, once)[1]) == content(again[1])


def test_follow_windows_repeats_a_batch(spark, tmp_path):
    """A run that fails after it wrote a batch, before the checkpoint has it, writes the same once more."""
    src, out, mark = (str(tmp_path / n) for n in ("events", "out", "checkpoint"))
    spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "event_type", "value").write.parquet(src)
    follow_windows(spark, src, out, mark, window_size=3)
    whole = [content(t) for t in tables(spark, out)]
    commits = f"{mark}/commits"
    for n in os.listdir(commits):
        os.remove(f"{commits}/{n}")
    repeated = follow_windows(spark, src, out, mark, window_size=3)
    assert repeated["windows"] > 0 and [content(t) for t in tables(spark, out)] == whole


def test_follow_windows_on_unusual_rows(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("events", "out", "checkpoint"))
    rows = [(1, 7, "error", 10.0), (2, 7, "error", None), (3, None, "error", 1.0), (None, 7, "error", 1.0), (4, 7, None, 90.0), (5, 7, None, 90.0), (6, 7, "view", 63.5), (7, 7, "view", 64.5), (7, 7, "view", 64.5)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(src)
    assert follow_windows(spark, src, out, mark, window_size=2)["windows"] == 3
    windows, orders = tables(spark, out)
    assert sorted(map(repr, (tuple(r) for r in windows.select("traj_id", "cluster", "widx", "frame", "value").collect()))) == expected_windows(rows, 2)
    assert [tuple(r)[:3] for r in orders.collect()] == [(7, 1, 4)]  # cluster 0 has no place in an order
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], EVENTS).write.parquet(empty)
    assert follow_windows(spark, empty, f"{out}2", f"{mark}2")["windows"] == 0 and tables(spark, f"{out}2")[0].count() == 0


def slow_fill(rows):
    """conv, turn, cluster, n, size, by hand."""
    words = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ")
    out = []
    for conv in {c for c, t, _ in rows if c is not None and t is not None}:
        own = [(t, x) for c, t, x in rows if c == conv and t is not None]
        w = [x for x in words(min(own, key=lambda r: (r[0], r[1] is not None, r[1]))[1]) if x]
        pairs = [(w[k], w[k + 1], 1 + 4 * k // (len(w) - 1)) for k in range(len(w) - 1)]
        for turn in {t for t, _ in own}:
            said = {x for t, text in own if t == turn for x in words(text) if x}
            for c in {p[2] for p in pairs}:
                mine = [p for p in pairs if p[2] == c]
                out.append((conv, turn, c, sum(a in said and b in said for a, b, _ in mine), len(mine)))
    return sorted(out)


def test_turn_fill_against_plain_python(spark):
    rng = random.Random(4)
    text = lambda: rng.choice([None, "", " \n"]) if rng.random() < 0.15 else rng.choice([" ", "\n", "\t "]).join(rng.choice(["a", "B", "b", "c", "d", "é", "É", "e."]) for _ in range(rng.randint(1, 12)))
    rows = [(c, rng.randrange(5), text()) for c in range(30) for _ in range(rng.randint(1, 8))] + [(None, 1, "a b"), (3, None, "a b")]
    got = turn_fill(spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string"))
    assert sorted(tuple(r) for r in got.collect()) == slow_fill(rows)
    assert turn_fill(spark.createDataFrame([], "conv_id bigint, turn bigint, text string")).count() == 0


def test_a_frequent_pair_meets_each_turn_once(spark):
    rows = [(1, 0, "the " * 3000)] + [(1, k, "the end the") for k in range(1, 200)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string")
    assert native_contacts(df).count() == 2999
    got = turn_fill(df).groupBy("frame").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).collect()
    assert len(got) == 200 and all((r["n"], r["size"]) == (2999, 2999) for r in got)


def test_turn_contacts_reruns_with_the_same_result(spark, tmp_path):
    src, out = f"{SF}/conversations.parquet", str(tmp_path / "out")
    first = turn_contacts(spark, src, out, buckets=4)
    whole = {n: content(spark.read.parquet(f"{out}/{n}")) for n in ("turns", "windows", "orders")}
    assert first == {"read": spark.read.parquet(src).count(), **{n: len(r) for n, r in whole.items()}} and all(whole.values())
    assert turn_contacts(spark, src, out, buckets=4) == first
    assert {n: content(spark.read.parquet(f"{out}/{n}")) for n in whole} == whole
    turns = spark.read.parquet(f"{out}/turns")
    assert {r["bucket"] for r in turns.select("bucket").distinct().collect()} <= {0, 1, 2, 3}
    opened = turns.join(turns.groupBy("conv_id").agg(F.min("turn").alias("turn")), ["conv_id", "turn"])
    assert opened.filter("n <> size").count() == 0  # an opening has all its contacts


def test_command_line(tmp_path, monkeypatch):
    seen, config = [], tmp_path / "c.toml"
    config.write_text('events = "a"\nwindow_size = 10\ncutoff = 0.5\n')

    class Session:
        class builder:
            appName = staticmethod(lambda name: Session.builder)
            getOrCreate = staticmethod(lambda: Session)

        @staticmethod
        def stop():
            seen.append("stopped")

    monkeypatch.setattr("pyspark.sql.SparkSession", Session)
    main(lambda spark, **v: seen.append(v), "job", ["--config", str(config), "--window-size", "3"])
    assert seen == [{"events": "a", "window_size": 3, "cutoff": 0.5}, "stopped"]
    with pytest.raises(SystemExit):
        main(lambda spark, **v: None, "job", ["--config", str(config), "--unknown", "1"])
