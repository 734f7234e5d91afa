"""Ways that keep rows off the driver and work off single tasks."""

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua import api
from residua.__main__ import main
from residua.operators import formation, graph, series
from residua.plans import catalog_large, figures, inputs
from residua.sources import pdb, sinks

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("most", [graph.GROUP_CELLS, 0])
def test_components_alone_are_clusters(spark, most):
    cells = spark.createDataFrame([("m", k, k, 50) for k in range(1, 9)] + [("m", 20 + k, 90 + k, 99) for k in range(3)] + [("m", 40, 70, 99)], "map_id string, ord bigint, i int, j int")
    found = {r["i"]: r["cluster"] for r in graph.cluster_contacts(cells, 5, 2, most=most, halve=False).collect()}
    assert found == {**dict.fromkeys(range(1, 9), 1), **dict.fromkeys((90, 91, 92), 2), 70: 0}


def test_small_maps_share_a_task(spark):
    cells = spark.range(3000).select((F.col("id") % 1000).cast("string").alias("map_id"), "id", F.floor(F.col("id") / 1000).cast("int").alias("i")).select("map_id", F.col("id").alias("ord"), "i", F.lit(7).alias("j"))
    found = graph.components(cells)
    assert found.count() == 3000 and found.filter("component <> 1").count() == 0
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()


@pytest.fixture
def nothing_fetched(monkeypatch):
    def no(*_):
        raise AssertionError("rows pass through the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", no)


def unpacked(data, bits=4):
    clear, at, width, out, prev, table = 1 << bits, 0, bits + 1, [], None, []
    while True:
        code = int.from_bytes(data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7) & ((1 << width) - 1)
        at += width
        if code == clear:
            table, width, prev = [bytes([k]) for k in range(clear)] + [b"", b""], bits + 1, None
            continue
        if code == clear + 1:
            return b"".join(out)
        own = table[code] if code < len(table) else prev + prev[:1]
        if prev is not None and len(table) < 4096:
            table.append(prev + own[:1])
        width += len(table) == 1 << width and width < 12
        out.append(own)
        prev = own


def test_gif_images_are_compressed():
    rng = np.random.default_rng(7)
    drawn = np.kron(rng.integers(0, 6, (22, 22)), np.ones((18, 18))).astype(np.uint8)
    for image in (drawn, rng.integers(0, 12, (396, 396)).astype(np.uint8), np.zeros((1, 1), np.uint8)):
        assert unpacked(figures._lzw(image)) == image.tobytes()
    assert len(figures._lzw(drawn)) < 12_000  # 105,000 as literal codes


def test_animations_are_coded_by_executors(spark, tmp_path, nothing_fetched):
    frames = spark.range(1, 40).selectExpr("cast(id as int) as frame").repartition(5)
    points = spark.createDataFrame([(1, 20, 10, 0), (39, 3, 1, 2)], "frame int, x int, y int, cluster int")
    assert figures.images_in(figures.animation(points, frames, 21, str(tmp_path / "a.gif"))) == (39, 396)
    assert figures.images_in(figures.movie(points, frames, 21, str(tmp_path / "a.mp4"))) == (39, 396)


def test_text_is_written_by_executors(spark, tmp_path, nothing_fetched):
    rows = [(f, 'a,"b"' if f % 2 else "plain", None if f == 3 else f / 2) for f in range(9, 0, -1)]
    sinks._write(spark.createDataFrame(rows, "frame int, text string, value double").repartition(4), "frame", ["frame", "text", "value"], str(tmp_path / "new" / "t.csv"), False)
    lines = (tmp_path / "new" / "t.csv").read_text().split("\n")
    assert lines[:4] == ["frame,text,value", '1,"a,""b""",0.5', "2,plain,1.0", '3,"a,""b""",'] and len(lines) == 11 and lines[-1] == ""


def test_rows_come_when_looked_at(spark):
    x = spark.createDataFrame([(f, {2: 0.5, 1: 1.0}) for f in range(5, 0, -1)], "frame int, clusters_filling map<int,double>")
    rows = api.Rows(x)
    assert len(rows) == 5 and rows[0] == {"frame": 1, "clusters_filling": {1: 1.0, 2: 0.5}} and rows[-1]["frame"] == 5
    assert [r["frame"] for r in rows] == [1, 2, 3, 4, 5] and rows == list(rows) and rows[1:3] == list(rows)[1:3]
    with pytest.raises(IndexError):
        rows[5]


def test_short_ranges_read_little():
    text = b"".join(b"MODEL %d\nATOM\nENDMDL\n" % k for k in range(200_000))

    class File:
        read = 0

        def read_at(self, n, at):
            self.read += n
            return text[at : at + n]

    file = File()
    assert len(list(pdb.models(file, len(text), 100_000, 105_000))) > 100
    assert file.read < 20_000  # over a million before


def test_streams_sources_are_no_single_task(spark, monkeypatch):
    def no(*_):
        raise AssertionError("one task writes the source")

    monkeypatch.setattr(DataFrame, "coalesce", no)
    windows = series.summarize(catalog_large.inputs.events_fill(spark, SF), 10, 62.0).select("traj_id", "widx", "cluster", "value")
    assert catalog_large._streamed(windows, ["widx = 0", "widx > 0"], catalog_large.stream_order, ["traj_id"]).columns[0] == "traj_id"


def test_equal_stretches_of_images_are_coded_once():
    rng = np.random.default_rng(5)
    cells = rng.integers(0, 6, (40, 22)).astype(np.uint8)
    before = figures._band.cache_info().misses
    for k in range(30):
        image = np.kron(cells[rng.permutation(40)[:22]], np.ones((18, 18), np.uint8))
        assert unpacked(figures._lzw(image)) == image.tobytes()
    assert figures._band.cache_info().misses - before <= 40
    for shape in ((1, 1), (1, 9), (7, 3), (3, 5000)):  # one row, many rows, a table that gets full
        for top in (1, 2, 12):
            image = rng.integers(0, top, shape).astype(np.uint8)
            assert unpacked(figures._lzw(image)) == image.tobytes()


def test_frames_are_analyzed_without_rows_of_contacts(spark):
    frames, contacts = inputs.frames(spark, SF).filter("frame <= 40"), inputs.contacts(spark, SF)
    some = frames.withColumn("coords", F.when(F.col("frame") % 7 == 0, F.map_filter("coords", lambda k, _: k % 3 == 1)).when(F.col("frame") == 5, F.map_filter("coords", lambda k, _: k < 0)).otherwise(F.col("coords")))
    odd = contacts.withColumn("r", F.when(F.col("ord") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("r")))
    for c in (odd, odd.limit(0)):
        found = formation.analyzed(some, c)[0]
        wanted = formation.frame_results(formation.evaluated(some, c))
        assert found.schema.simpleString() == wanted.schema.simpleString()
        assert found.orderBy("frame").collect() == wanted.orderBy("frame").collect()
        assert "collect_list(CASE" not in found._jdf.queryExecution().toString() and "hashpartitioning(traj_id" not in found._jdf.queryExecution().toString()


def test_a_given_summary_needs_no_trajectory(spark, tmp_path):
    (tmp_path / "t.pdb").write_text("MODEL 1\nENDMDL\n")
    (tmp_path / "c.csv").write_text("i,j,r,cluster\n1,4,5.0,1\n")
    (tmp_path / "s.csv").write_text("frame,cluster_1\n1,0\n3,1\n")
    own = (str(tmp_path / "t.pdb"), "-c", str(tmp_path / "c.csv"), "--summary-csv", str(tmp_path / "s.csv"))
    assert main(["trajectory", "plot-summary", *own], spark) == 0 and main(["trajectory", "classify", *own], spark) == 0
    assert not (tmp_path / "t_parsed.csv").exists() and (tmp_path / "t_class.txt").read_text() == "1\n"
