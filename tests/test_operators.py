"""Hand-made fixtures, step-by-step walks and invariants of the operators."""

import random
import time

import pytest
from pyspark.sql import functions as F

from residua.functions.schemas import CONTACTS, COORDS, FRAMES
from residua.operators import formation, graph, ordering, series, views
from residua.plans.pipeline import analyze
from residua.streaming.frames import stream_fill, stream_windows

MAP = [(0, 1, 4, 5.0, 1), (1, 2, 5, 5.0, 1), (2, 1, 5, 5.0, 2), (3, 2, 6, 4.0, 0)]
P = {1: {1: (0, 0, 0), 2: (3.8, 0, 0), 4: (5, 0, 0), 5: (6, 0, 0)}, 2: {1: (0, 0, 0), 2: (20, 0, 0), 4: (10, 0, 0), 5: (20, 3, 4), 6: (20, 0, 4.7)}, 3: {}}


@pytest.fixture(scope="module")
def contacts(spark):
    return spark.createDataFrame(MAP, CONTACTS)


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame([("t", f, {r: tuple(map(float, p)) for r, p in c.items()}) for f, c in P.items()], FRAMES)


@pytest.mark.parametrize("limit", [100, 0])
def test_formation(frames, contacts, limit):
    e = formation.evaluated(frames, contacts, broadcast_contacts=limit)
    rows = {r["frame"]: r for r in formation.frame_results(e).collect()}
    assert [[tuple(p) for p in rows[f]["contact_list"]] for f in (1, 2, 3)] == [[(1, 4), (2, 5)], [(2, 5), (2, 6)], []]
    assert [rows[f]["clusters_filling"] for f in (1, 2, 3)] == [{0: 0.0, 1: 1.0, 2: 0.0}, {0: 1.0, 1: 0.5, 2: 0.0}, {0: 0.0, 1: 0.0, 2: 0.0}]
    assert [(rows[f]["contacts"], rows[f]["q"]) for f in (1, 2, 3)] == [(2, 0.5), (2, 0.5), (0, 0.0)]
    assert {(r["frame"], r["cluster"], r["n"], r["size"]) for r in formation.fill(e).collect()} == {(1, 0, 0, 1), (1, 1, 2, 2), (1, 2, 0, 1), (2, 0, 1, 1), (2, 1, 1, 2), (2, 2, 0, 1), (3, 0, 0, 1), (3, 1, 0, 2), (3, 2, 0, 1)}
    assert {(r["frame"], r["contacts"], r["q"]) for r in formation.frame_q(e).collect()} == {(1, 2, 0.5), (2, 2, 0.5), (3, 0, 0.0)}


def test_formation_without_contacts_and_with_nan(spark, frames, contacts):
    none = formation.evaluated(frames, contacts.limit(0))
    assert {(r["frame"], r["contacts"], r["q"], len(r["clusters_filling"])) for r in formation.frame_results(none).collect()} == {(f, 0, 0.0, 0) for f in P}
    nan = spark.createDataFrame([(0, 1, 4, float("nan"), 1), (1, 1, 4, float("inf"), 1), (2, 1, 4, 5.0, 1), (3, 1, 4, 5.0, 1)], CONTACTS)
    one = formation.frame_results(formation.evaluated(frames.filter("frame = 1"), nan)).first()
    assert one["contacts"] == 3 and one["q"] == 0.75  # repeated contacts count each time


def test_pack_and_unpack(spark, frames):
    long = formation.unpack(frames)
    assert long.schema == spark.createDataFrame([], COORDS).schema or long.columns == ["traj_id", "frame", "residue", "x", "y", "z"]
    assert formation.unpack(formation.pack(long)).exceptAll(long).count() == 0


def fill_of(spark, values, start=None, size=4):
    frames_ = start or range(1, len(values) + 1)
    return spark.createDataFrame([("t", f, 1, int(v * size), size) for f, v in zip(frames_, values)], "traj_id string, frame int, cluster int, n bigint, size bigint")


def test_summarize(spark):
    x = fill_of(spark, [1, 0.5, 0, 0, 1], [1, 2, 5, 9, 10])
    got = lambda d: [(r["frame"], r["value"]) for r in d.orderBy("widx").collect()]
    assert got(series.summarize(x, 2)) == [(1, 0.75), (5, 0.0), (10, 1.0)]
    assert got(series.summarize(x, 2, 0.75)) == [(1, 1.0), (5, 0.0), (10, 1.0)]
    assert got(series.summarize(x, 2, width=3)) == got(series.summarize(x, 2))
    assert got(series.summarize(x, 100)) == [(1, 0.5)]
    assert got(series.summarize_values(x.withColumn("value", F.col("n") / F.col("size")), 2)) == [(1, 0.75), (5, 0.0), (10, 1.0)]
    with pytest.raises(ValueError):
        series.summarize(x, 0)


def test_smooth(spark):
    x = fill_of(spark, [1, 0.5, 0, 0, 1], [1, 2, 5, 9, 10])
    got = lambda d: [r["value"] for r in d.orderBy("frame").collect()]
    assert got(series.smooth(x, 2)) == [0.75, 0.5, pytest.approx(1 / 6), pytest.approx(1 / 3), 0.5]
    assert got(series.smooth(x, 0)) == got(series.smooth(x, 1)) == [1, 0.5, 0, 0, 1]


def test_smooth_in_ranges(spark):
    rng = random.Random(3)
    values, at = [rng.randint(0, 4) / 4 for _ in range(300)], sorted(rng.sample(range(1, 2000), 300))
    x = fill_of(spark, values, at)
    for w in (2, 7, 100, 1000):
        h = w // 2
        expected = [sum(values[max(0, k - h) : k + h + 1]) / len(values[max(0, k - h) : k + h + 1]) for k in range(300)]
        assert [r["value"] for r in series.smooth(x, w, width=16).orderBy("frame").collect()] == pytest.approx(expected)


def binary_of(spark, rows, traj="t"):
    return [(traj, w, w * 10, c + 1, float(v)) for w, row in enumerate(rows) for c, v in enumerate(row)]


SUMMARY = "traj_id string, widx bigint, frame int, cluster int, value double"


@pytest.mark.parametrize("rows,start,order", [
    (["100", "001", "101", "111"], 3, [3, 1, 2]), (["000", "111"], 1, [3, 2, 1]), (["100", "110", "010"], 1, [1, 2]), (["111"], 0, [3, 2, 1])])
def test_order(spark, rows, start, order):
    x = spark.createDataFrame(binary_of(spark, [[int(v) for v in r] for r in rows]) + [("t", 0, 0, 0, 1.0)], SUMMARY)
    assert ordering.start_window(x).first()["start"] == start
    assert [r["cluster"] for r in ordering.formation_order(x).orderBy("rank").collect()] == order
    assert ordering.order_text(ordering.formation_order(x)).first()["formation"] == ",".join(map(str, order))


def test_order_of_nothing(spark):
    x = spark.createDataFrame(binary_of(spark, [[0, 0], [0, 0]]), SUMMARY)
    with pytest.raises(Exception, match="ever forms"):
        ordering.formation_order(x).collect()
    assert ordering.formation_order(x, strict=False).count() == 0


def back(rows):
    """The walk from the start window back to the first, taking down breaks."""
    counts = [sum(r) for r in rows]
    if not max(counts):
        return None
    s = next((k for k, c in enumerate(counts) if c == len(rows[0])), counts.index(max(counts)))
    seen = []
    for t in range(s, 0, -1):
        seen += [c for c in range(len(rows[0])) if rows[t][c] and not rows[t - 1][c] and c not in seen]
    seen += [c for c in range(len(rows[0])) if rows[0][c] and c not in seen]
    return [c + 1 for c in reversed(seen)]


def test_order_of_random_matrices(spark):
    rng, rows, expected = random.Random(9), [], {}
    for k in range(300):
        m = [[rng.randint(0, 1) for _ in range(rng.choice([1, 2, 4]))] for _ in range(1)]
        m += [[rng.randint(0, 1) for _ in m[0]] for _ in range(rng.randint(0, 6))]
        rows += binary_of(spark, m, f"t{k}")
        if (order := back(m)) is not None:
            expected[f"t{k}"] = ",".join(map(str, order))
    got = ordering.order_text(ordering.formation_order(spark.createDataFrame(rows, SUMMARY), strict=False))
    assert {r["traj_id"]: r["formation"] for r in got.collect()} == {k: v for k, v in expected.items() if v}


CELLS = "map_id string, ord bigint, i int, j int"
A, B, C = [(1, 10), (1, 11), (2, 12), (2, 13), (3, 13)], [(20, 30), (21, 31)], [(13, 1)]


def cells(spark, *groups):
    return spark.createDataFrame([("m", k, *c) for k, c in enumerate(c for g in groups for c in g)], CELLS)


def test_graph(spark):
    x = cells(spark, A, B, C)
    found = {}
    for r in graph.components(x).collect():
        found.setdefault(r["component"], set()).add((r["i"], r["j"]))
    assert found == {1: set(A), 2: set(B), 3: set(C)}
    wide = {}
    for r in graph.components_wide(x).collect():
        wide.setdefault((r["root_i"], r["root_j"]), set()).add((r["i"], r["j"]))
    assert wide == {A[0]: set(A), B[0]: set(B), C[0]: set(C)}
    assert graph.adjacency_edges(x).count() == 2 * (5 + 1)
    label = lambda d: {(r["i"], r["j"]): r["cluster"] for r in d.collect()}
    assert label(graph.cluster_contacts(x, 1, 5)) == {**dict.fromkeys(A, 1), **dict.fromkeys(B + C, 0)}
    assert set(label(graph.cluster_contacts(x, 1, 6)).values()) == {0}
    assert label(graph.cluster_contacts(x, 2, 1)) == {**dict.fromkeys(A, 1), **dict.fromkeys(B, 2), **dict.fromkeys(C, 0)}


def test_split_ends_and_halves(spark):
    odd = cells(spark, [(10, 20), (10, 21), (11, 21), (12, 22)])
    assert {r["cluster"] for r in graph.cluster_contacts(odd, 5, 4).collect()} <= {1, 2}
    line = cells(spark, [(k, 50) for k in range(12)])
    got = graph.cluster_contacts(line, 3, 5).groupBy("cluster").agg(F.count("*").alias("n"), F.min("i").alias("a"), F.max("i").alias("b")).collect()
    assert sorted(r["cluster"] for r in got) == [1, 2, 3] and all(r["b"] - r["a"] + 1 == r["n"] for r in got)


def test_views(frames, contacts):
    r = formation.frame_results(formation.evaluated(frames, contacts))
    assert {tuple(p) for p in views.animation_points(r, contacts).filter("frame = 2").select("cluster", "x", "y").collect()} == {(1, 5, 2), (0, 6, 2)}
    assert views.animation_titles(r).filter("frame = 1").first()["title"] == "Frame 1 | Contacts: 2 | Q: 0.500"
    assert views.contact_map_stats(contacts).first().asDict() == {"total": 4, "clustered": 3, "unassigned": 1, "below_diagonal": 4, "clusters": 2, "max_residue": 6}
    assert views.contact_map_points(contacts).count() == 4
    assert formation.read_stats(r).first().asDict() == {"frames": 3, "min_q": 0.0, "max_q": 0.5, "mean_contacts": 4 / 3}


def test_pipeline_invariants(frames, contacts):
    a = analyze(frames, contacts, window_size=1, smooth_window=1, strict=False)
    for r in a.results.collect():
        own = {x["cluster"]: (x["n"], x["size"]) for x in a.fill.filter(F.col("frame") == r["frame"]).collect()}
        assert sum(n for n, _ in own.values()) == r["contacts"] == r["q"] * 4
    assert a.smoothed.count() == a.fill.count() == a.summary.count()


def test_streams(spark, frames, contacts, tmp_path):
    fill = stream_fill(frames, contacts.collect())
    batch = {(r["frame"], r["cluster"], r["n"], r["size"]) for r in fill.select("frame", F.inline("clusters")).collect()}
    assert batch == {(r["frame"], r["cluster"], r["n"], r["size"]) for r in formation.fill(formation.evaluated(frames, contacts)).collect()}
    for k in range(2):
        frames.withColumn("frame", F.col("frame") + 3 * k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_windows(stream_fill(stream, contacts.collect()), 2).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.sql("select widx, frame, cluster, value from windows").collect()
    assert {r["widx"] for r in got} == {0, 1, 2} and len(got) == 9


def test_smooth_values_in_ranges(spark):
    rng = random.Random(8)
    for n in (2, 60, 333):
        values, at = [rng.random() for _ in range(n)], sorted(rng.sample(range(1, 3000), n))
        x = spark.createDataFrame([("t", f, 1, v, "x") for f, v in zip(at, values, strict=True)] + [("t", 5, 2, 0.5, "y")], "traj_id string, frame int, cluster int, value double, more string").repartition(3)
        for w, widths in ((1, [16]), (2, [16]), (7, [16, series.RANGE]), (64, [16, series.RANGE]), (1000, [16])):
            h = w // 2
            expected = [sum(values[max(0, k - h) : k + h + 1]) / len(values[max(0, k - h) : k + h + 1]) for k in range(n)]
            for width in widths:
                got = series.smooth_values(x, w, width=width)
                assert got.columns == x.columns and [r["value"] for r in got.filter("cluster = 1").orderBy("frame").collect()] == pytest.approx(expected, abs=1e-14), (n, w, width)
                assert [tuple(r) for r in got.filter("cluster = 2").collect()] == [("t", 5, 2, 0.5, "y")]


def test_large_maps_go_by_joins(spark):
    rng = random.Random(2)
    rows = [(m, k, rng.randint(1, 22), rng.randint(30, 52)) for m, n in (("a", 150), ("b", 90), ("c", 6)) for k in range(n)]
    x = spark.createDataFrame(rows, CELLS)
    own = lambda d: sorted(map(tuple, d.collect()))
    assert own(graph.components(x, most=50)) == own(graph.components(x))
    for k, least in ((2, 3), (40, 1)):
        assert own(graph.cluster_contacts(x, k, least, most=50).select("map_id", "ord", "i", "j", "cluster")) == own(graph.cluster_contacts(x, k, least).select("map_id", "ord", "i", "j", "cluster"))


def test_large_contact_lists_are_not_multiplied(frames, contacts):
    small, large = formation.analyzed(frames, contacts), formation.analyzed(frames, contacts, broadcast_contacts=0)
    for a, b in zip(small, large, strict=True):
        assert sorted(a.columns) == sorted(b.columns)
        assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(a.columns)).collect()))
    plan = large[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "Inner, true" not in plan.replace("Join Inner, true", "", 1)  # the one row of sizes alone


def test_streams_end(spark, frames, contacts, tmp_path):
    """Three windows of two frames in order of arrival; the last frame, alone in its window, comes out when the trajectory is idle."""
    for k in range(2):
        frames.filter(F.col("frame") <= 4 - k).withColumn("frame", F.col("frame") + 3 * k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frames.filter("frame = 1").withColumn("frame", F.lit(9)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    x = stream_windows(stream_fill(stream, contacts.collect()), 2, idle="2 seconds")
    q = x.writeStream.format("memory").queryName("ends").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            if spark.sql("select * from ends where widx = 3").count():
                break
            time.sleep(1)
    finally:
        q.stop()
    whole = formation.fill(formation.evaluated(spark.read.parquet(str(tmp_path / "in")), contacts))
    batch = {(r["widx"], r["frame"], r["cluster"], r["value"]) for r in series.summarize(whole, 2).collect()}
    got = [(r["widx"], r["frame"], r["cluster"], r["value"]) for r in spark.sql("select * from ends").collect()]
    assert set(got) == batch and len(got) == len(batch) == 12


def test_means_of_fractions_are_the_same_in_any_order(spark):
    import math
    import random
    from fractions import Fraction

    rng = random.Random(6)
    rows = [("t", f, c, rng.choice([rng.random(), rng.random() * 1e-9, rng.randint(0, 10**6) / 7, 0.1])) for c in (1, 2) for f in range(400)]
    df = spark.createDataFrame(rows, "traj_id string, frame int, cluster int, value double")
    found = []
    for x in (df.coalesce(1), df.repartition(7), df.orderBy(F.rand(3)).repartition(3)):
        found.append((sorted(map(tuple, series.smooth_values(x, 9, width=64).collect())), sorted(map(tuple, series.summarize_values(x, 9).collect()))))
    assert found[0] == found[1] == found[2]
    digits = lambda v: Fraction(str(v)).limit_denominator(10**18) if v < 1e-3 else Fraction(str(v))
    for _, f, c, v in found[0][0]:
        own = [digits(r[3]) for r in rows if r[2] == c and abs(r[1] - f) <= 4]
        assert v == pytest.approx(float(sum(own) / len(own)), rel=1e-15, abs=1e-17)
    odd = [("t", k, 1, v) for k, v in enumerate([1.0, math.inf, 2.0, 3.0, math.nan, 5.0, -math.inf, math.inf, 8.0, 8.0])]
    got = [r["value"] for r in series.smooth_values(spark.createDataFrame(odd, df.schema), 2).orderBy("frame").collect()]
    assert [str(v) for v in got] == ["inf", "inf", "inf", "nan", "nan", "nan", "nan", "nan", "inf", "8.0"]
    with pytest.raises(Exception, match="too large to sum"):
        series.summarize_values(spark.createDataFrame([("t", 1, 1, 1e30)], df.schema), 2).collect()
