"""PDB scan against a line-by-line state machine, text readers and writers."""

import random

import pytest
from pyspark.sql import functions as F

from residua.functions.columns import list_text, map_text, number_text, parse_list, parse_map, strict_double
from residua.operators.formation import unpack
from residua.sources.pdb import read_pdb
from residua.sources.tables import read_contacts, read_contacts_raw


def ca(res, x=0.0):
    return f"ATOM  {1:5d}  CA  ALA A{res:4d}    {x:8.3f}{0:8.3f}{0:8.3f}  1.00"


def walk(lines, max_frames=None):
    """The reader's rules one line at a time."""
    if max_frames == 0:
        return {}
    done, now, frame, saved, seen_model = {}, {}, None, True, False
    for v in lines:
        if v.startswith("MODEL"):
            if frame is not None and not saved:
                done[frame] = now
            if max_frames is not None and len(done) >= max_frames:
                return done
            seen_model, frame, now, saved = True, int(v.split()[1]), {}, False
        elif v.startswith("ENDMDL"):
            if frame is not None and not saved:
                done[frame], saved = now, True
                if max_frames is not None and len(done) >= max_frames:
                    return done
        elif v.startswith("ATOM") and " CA " in v and len(v) >= 54:
            try:
                r, x = int(v[22:26]), float(v[30:38])
            except ValueError:
                continue
            if seen_model or frame is None:
                now = {**now, r: x}
    if frame is None:
        return {1: now} if now else {}
    if not saved and now and (max_frames is None or len(done) < max_frames or frame in done):
        done[frame] = now
    return done


def scan(spark, path, max_frames=None):
    return {r["frame"]: {k: p["x"] for k, p in r["coords"].items()} for r in read_pdb(spark, str(path), max_frames).collect()}


CASES = {
    "around": ([ca(9), "MODEL 1", ca(1), "ENDMDL", ca(3), "MODEL 2", "ENDMDL", "MODEL 3", ca(1)], None, {1: {1}, 2: set(), 3: {1}}),
    "last_empty": (["MODEL 1", ca(1), "MODEL 2"], None, {1: {1}}),
    "first_empty": (["MODEL 1", "MODEL 2", ca(1)], None, {1: set(), 2: {1}}),
    "replaced": (["MODEL 1", ca(1), "ENDMDL", "MODEL 1", ca(2), "ENDMDL"], None, {1: {2}}),
    "no_model": ([ca(1), ca(2), "ENDMDL", ca(3)], None, {1: {1, 2, 3}}),
    "limit": (["MODEL 7", ca(1), "ENDMDL", "MODEL 3", ca(1), "ENDMDL"], 1, {7: {1}}),
    "limit_0": (["MODEL 7", ca(1), "ENDMDL"], 0, {}),
    "skipped": (["MODEL 1", ca(1).replace("ATOM  ", "HETATM"), ca(2)[:53], ca(3).replace("0.000", "x.000", 1), ca(4), "ENDMDL"], None, {1: {4}}),
    "empty": ([], None, {}),
}


@pytest.mark.parametrize("name", CASES)
def test_pdb_cases(spark, tmp_path, name):
    lines, most, expected = CASES[name]
    (p := tmp_path / "t.pdb").write_text("\n".join(lines) + "\n")
    assert {k: set(v) for k, v in scan(spark, p, most).items()} == expected


def test_pdb_last_line_wins_and_carriage_returns(spark, tmp_path):
    (p := tmp_path / "t.pdb").write_bytes("\r\n".join(["MODEL 1", ca(1, 1.0), ca(1, 2.0), "ENDMDL", ""]).encode())
    assert scan(spark, p) == {1: {1: 2.0}}


def test_pdb_without_number(spark, tmp_path):
    (p := tmp_path / "t.pdb").write_text("MODEL\n" + ca(1) + "\nENDMDL\n")
    with pytest.raises(Exception, match="no frame number"):
        scan(spark, p)


def test_pdb_random_files(spark, tmp_path):
    rng, texts = random.Random(5), []
    for k in range(40):
        lines = [rng.choice([f"MODEL {rng.randint(1, 4)}", "ENDMDL", ca(rng.randint(1, 3), rng.randint(1, 9)), "REMARK a MODEL"]) for _ in range(rng.randint(1, 14))]
        (tmp_path / f"f{k:02}.pdb").write_text("\n".join(lines) + "\n")
        texts.append(lines)
    for most in (None, 1, 2):
        got = {}
        for r in read_pdb(spark, str(tmp_path), most).collect():
            got.setdefault(int(r["traj_id"][-6:-4]), {})[r["frame"]] = {k: p["x"] for k, p in r["coords"].items()}
        for k, lines in enumerate(texts):
            assert got.get(k, {}) == walk(lines, most), (most, lines)


def test_pdb_reads_a_file_in_splits(spark, tmp_path):
    (p := tmp_path / "t.pdb").write_text("".join(f"MODEL {k}\n{ca(1, k % 100)}\nENDMDL\n" for k in range(1, 2001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        x = read_pdb(spark, str(p), 1500)
        assert {(r["frame"], r["x"]) for r in unpack(x).collect()} == {(k, float(k % 100)) for k in range(1, 1501)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_raw_contacts(spark, tmp_path):
    (p := tmp_path / "a.cont").write_text("1 4 2.0 0.6\n  2\t5   0 1 9 9\n\n")
    rows = read_contacts_raw(spark, str(p)).orderBy("ord").collect()
    assert [(r["i"], r["j"]) for r in rows] == [(1, 4), (2, 5)] and rows[0]["r"] == pytest.approx(6.0) and rows[1]["r"] == float("inf")
    (p := tmp_path / "b.cont").write_text("1 4 -2.0 0.6\n")
    with pytest.raises(Exception, match="no native distance"):
        read_contacts_raw(spark, str(p)).collect()


def test_clustered_contacts(spark, tmp_path):
    (p := tmp_path / "a.csv").write_text("cluster,j,extra,i,r\n1,4,z,1,5.0\n0,5,z,2,inf\n")
    assert [tuple(r) for r in read_contacts(spark, str(p)).orderBy("ord").select("i", "j", "r", "cluster").collect()] == [(1, 4, 5.0, 1), (2, 5, float("inf"), 0)]
    (p := tmp_path / "b.csv").write_text("i,j,r\n1,4,5.0\n")
    with pytest.raises(ValueError, match="cluster"):
        read_contacts(spark, str(p))
    (p := tmp_path / "c.csv").write_text("i,j,r,cluster\n1,x,5.0,1\n")
    with pytest.raises(Exception, match="bad j"):
        read_contacts(spark, str(p)).collect()


def test_texts(spark):
    numbers = [1.0, 0.0, 0.5, 1 / 3, 1e-7, 1.5e-5, 12345678.9, 1e20, 123456789012345680.0, -2.5e-9, 1e7]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in numbers], "v double").select(number_text(F.col("v"))).collect()]
    assert [float(t) for t in got] == numbers and not any("E" in t for t in got)
    assert got[0] == "1" and got[1] == "0" and got[4] == "0.0000001" and got[7] == "1" + "0" * 20
    x = spark.createDataFrame([("{}",), ("{0: 0.5, 1: 1}",)], "t string").select(parse_map(F.col("t")).alias("m"))
    assert [r["m"] for r in x.collect()] == [{}, {0: 0.5, 1: 1.0}]
    assert [r[0] for r in x.select(map_text("m")).collect()] == ["{}", "{0: 0.5, 1: 1}"]
    x = spark.createDataFrame([("[]",), ("[(1, 4), (2, 5)]",)], "t string").select(parse_list(F.col("t")).alias("l"))
    assert [r[0] for r in x.select(list_text(F.col("l"))).collect()] == ["[]", "[(1, 4), (2, 5)]"]
    for bad in ("0: 1}", "{0: 1: 2}", "{a: 1}"):
        with pytest.raises(Exception, match="not a map"):
            spark.createDataFrame([(bad,)], "t string").select(parse_map(F.col("t"))).collect()
    assert [r[0] for r in spark.createDataFrame([(v,) for v in ("1.0f", "1e3", " inf ", ".5", "x")], "t string").select(strict_double(F.col("t"))).collect()] == [None, 1000.0, float("inf"), 0.5, None]


def test_parts_hold_the_lines_of_the_single_file(spark, tmp_path):
    from residua.sources import sinks

    rows = [(k, k % 3, k / 7, [(1, k), (2, 3)][: k % 3], {0: 0.5, 1: float(k % 2)} if k % 2 else {2: 1.0}) for k in random.Random(1).sample(range(200), 200)]
    x = spark.createDataFrame(rows, "frame int, contacts bigint, q double, contact_list array<struct<i:int,j:int>>, clusters_filling map<int,double>")
    sinks.write_parsed(x, str(tmp_path / "one.csv"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would make one part
    try:
        sinks.write_parsed(x.repartition(5), str(tmp_path / "parts"), parts=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [p.read_text().splitlines() for p in sorted((tmp_path / "parts").glob("part-*"))]
    one = (tmp_path / "one.csv").read_text().splitlines()
    assert len(parts) > 1 and all(p[0] == one[0] for p in parts) and [v for p in parts for v in p[1:]] == one[1:]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_parsed(x, str(tmp_path / "parts"), parts=True)
