"""The PDB reader's byte ranges, its index, and further formats."""

import io
import random

import numpy as np
import pytest
from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import functions as F

from residua.operators.formation import pack, unpack
from residua.sources import files, formats, pdb
from tests.test_sources import ca, walk


class File(io.BytesIO):
    """As pyarrow's files; counts what is read."""

    total = 0

    def read_at(self, n, at):
        self.total += n
        return self.getvalue()[at : at + n]


def by_ranges(data, wide, most=None):
    """Frames by the two passes, without Spark: models of all ranges, the last of each number, parsed."""
    rows = []
    for start in range(0, len(data), wide if most is None else max(1, len(data))):
        rows += pdb.models(File(data), len(data), start, min(len(data), start + wide) if most is None else len(data), most)
    assert len({r[0] for r in rows}) == len(rows)  # each model belongs to one range
    last = {r[2]: r for r in sorted(rows)}
    out = {}
    for number, (offset, length, _, _, lone) in last.items():
        _, residue, point = pdb.atoms(data[offset : offset + length], [0], [lone])
        out[number] = dict(zip(residue.tolist(), point[:, 0].tolist(), strict=True))
    return out


@pytest.mark.parametrize("block", [1 << 20, 16])
def test_any_ranges_give_the_same_frames(monkeypatch, block):
    monkeypatch.setattr(pdb, "BLOCK", block)
    rng = random.Random(11)
    for _ in range(1500):
        lines = [rng.choice([f"MODEL {rng.randint(1, 4)}", f"MODEL     {rng.randint(1, 3)} x", "ENDMDL", ca(rng.randint(1, 3), rng.randint(1, 9)), "REMARK a MODEL", "", ca(2).replace("ATOM  ", "HETATM"), ca(5)[:50], "MODE", "ENDMD"]) for _ in range(rng.randint(0, 14))]
        data = rng.choice(["\n", "\r\n"]).join(lines).encode() + rng.choice([b"", b"\n"])
        most = rng.choice([None, None, 1, 2, 3])
        assert by_ranges(data, rng.choice([1, 7, 20, 90, 10_000]), most) == walk(lines, most), (lines, most)


def test_fields_are_read_as_strictly_as_by_words():
    good, bad = ["   1.000", "-1e3    ", "   +2.5 ", "     inf", "     NaN", "      .5", "      5."], ["   1_000", "   1.0d ", "  0x1.00", "        ", "  1.0 2 ", "  --1.00", "      1f"]
    fields = np.frombuffer("".join(good + bad).encode(), dtype=np.uint8).reshape(-1, 8)
    values, ok = pdb.numbers(fields, b"+-.0123456789eE infatyINFATY", float)
    assert ok.tolist() == [True] * len(good) + [False] * len(bad)
    assert np.array_equal(values[: len(good)], [1.0, -1000.0, 2.5, np.inf, np.nan, 0.5, 5.0], equal_nan=True)
    values, ok = pdb.numbers(np.frombuffer(b"  12 -3 +4   1_2 1 2 - 1 ", dtype=np.uint8)[:24].reshape(-1, 4), b"+-0123456789 ", int)
    assert values[ok].tolist() == [12, -3, 4] and ok.tolist() == [True, True, True, False, False, False]
    assert [pdb.number_of(h) for h in (b"MODEL 3", b"MODEL", b"MODEL x", b"MODEL 1_0", b"MODEL 99999999999", b"MODEL -2 of 9")] == [3, None, None, None, None, -2]


def test_a_saved_index_reads_only_what_is_asked_for(spark, tmp_path):
    text = "".join(f"MODEL {k}\n{ca(1, k % 100)}\n{ca(2, 1)}\nENDMDL\n" for k in range(1, 5001))
    (p := tmp_path / "t.pdb").write_text(text)
    index = str(tmp_path / "index")
    pdb.index_pdb(spark, str(p), wide=10_000).write.parquet(index)
    kept = pdb.kept_models(spark.read.parquet(index), 10)
    assert kept.agg(F.sum("length")).first()[0] < len(text) / 100
    got = unpack(pdb.read_pdb(spark, "/not/looked/at", 10, index=index)).collect()
    assert {(r["frame"], r["residue"], r["x"]) for r in got} == {(k, j, float(k if j == 1 else 1)) for k in range(1, 11) for j in (1, 2)}
    assert pdb.read_pdb(spark, "", index=index).count() == 5000 and pdb.read_pdb(spark, "", 0, index=index).count() == 0
    f = File(text.encode())  # without an index the first pass ends early, too
    assert len(list(pdb.models(f, len(text), 0, len(text), 10))) == 10 and f.total <= pdb.BLOCK + pdb.HEAD


def test_limits_by_index_are_those_of_the_scan(spark, tmp_path):
    rng, texts = random.Random(12), []
    for k in range(25):
        lines = [rng.choice([f"MODEL {rng.randint(1, 5)}", "ENDMDL", ca(rng.randint(1, 3), rng.randint(1, 9))]) for _ in range(rng.randint(1, 16))]
        (tmp_path / f"f{k:02}.pdb").write_text("\n".join(lines) + "\n")
        texts.append(lines)
    index = pdb.index_pdb(spark, str(tmp_path), wide=40).cache()
    for most in (None, 1, 2, 3):
        x = pdb.parsed(pdb.kept_models(index, most, width=64), 3, 40)
        got = {}
        for r in x.collect():
            got.setdefault(int(r["traj_id"][-6:-4]), {})[r["frame"]] = {k: p["x"] for k, p in r["coords"].items()}
        for k, lines in enumerate(texts):
            assert got.get(k, {}) == walk(lines, most), (most, lines)


def test_paths_with_unusual_names(spark, tmp_path):
    (d := tmp_path / "a b%20c" / "run=1").mkdir(parents=True)
    (d / "t é#1.pdb").write_text(f"MODEL 1\n{ca(1, 4)}\nENDMDL\n")
    (d / "empty.pdb").write_text("")
    (r,) = pdb.read_pdb(spark, str(tmp_path / "a b%20c")).collect()
    assert r["frame"] == 1 and r["coords"][1]["x"] == 4.0 and r["traj_id"].startswith("file:///")


def test_many_files_are_listed_and_written_by_executors(spark, tmp_path):
    """The same files as Spark's own listing has, but not by one task a folder, nor kept by the driver."""
    rows = spark.range(90).selectExpr("concat('k=', cast(id % 45 as string)) as folder", "concat('a %é#', cast(id as string), '.pdb') as name", "concat('x', cast(id as string)) as value")
    assert files.write_files(rows, f"file://{tmp_path}") == files.write_files(rows, f"file://{tmp_path}") == 90
    assert sorted(p.read_text() for p in tmp_path.rglob("*.pdb")) == sorted(f"x{k}" for k in range(90))
    for name in ("k=1/.hidden.pdb", "k=1/_hidden.pdb", "_k/x.pdb", "plain/x.pdb"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("y")
    with pytest.raises(PythonException, match="folder beside folders named column=value"):
        pdb.listed(spark, str(tmp_path))
    (tmp_path / "plain/x.pdb").unlink()
    (tmp_path / "k=2/b").mkdir()
    (tmp_path / "k=2/b/c.pdb").write_text("y")
    name = F.regexp_replace("_metadata.file_path", "^file:/(?!/)", "file:///")
    own = spark.read.format("binaryFile").load(str(tmp_path)).select(name.alias("traj_id"), "path", F.col("length").alias("size"))
    got = pdb.listed(spark, str(tmp_path))
    assert "binaryFile" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, own.collect())) and got.count() == 91
    assert "binaryFile" in pdb.listed(spark, f"{tmp_path}/k=[34]")._jdf.queryExecution().toString() and pdb.listed(spark, f"{tmp_path}/k=[34]").count() == 4
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        pdb.listed(spark, f"{tmp_path}/none").count()


def test_formats(spark, tmp_path):
    rows = [("t", f, r, f * 1.0, r * 1.0, 0.5) for f in (1, 2, 5) for r in (1, 2, 3)]
    points = spark.createDataFrame(rows, "traj_id string, frame int, residue int, x double, y double, z double")
    for name in ("parquet", "orc", "json", "csv"):
        writer = points.write.format(name)
        (writer.option("header", True) if name == "csv" else writer).save(str(tmp_path / f"p.{name}"))
        assert sorted(tuple(r) for r in unpack(formats.read_frames(spark, str(tmp_path / f"p.{name}"))).collect()) == rows
        assert formats.read_frames(spark, str(tmp_path / f"p.{name}"), max_frames=2).select("frame").distinct().count() == 2
    (tmp_path / "t.pdb").write_text(f"MODEL 9\n{ca(1, 4)}\nENDMDL\n")
    assert formats.read_frames(spark, str(tmp_path / "t.pdb")).first()["frame"] == 9
    odd = spark.createDataFrame([(1, 1, 1.0, None, 0.0), (1, 1, 2.0, 1.0, 0.0), (1, 1, 3.0, 0.0, 0.0), (None, 1, 1.0, 1.0, 1.0)], "frame int, residue int, x double, y double, z double")
    odd.coalesce(1).write.parquet(str(tmp_path / "odd.parquet"))
    (r,) = unpack(formats.read_frames(spark, str(tmp_path / "odd.parquet"))).collect()
    assert (r["frame"], r["x"], r["y"]) == (1, 3.0, 0.0) and r["traj_id"].endswith(".parquet")
    with pytest.raises(ValueError, match="no such format: xyz; there are"):
        formats.read_frames(spark, "a.xyz")
    points.select("frame", "residue", "x").write.parquet(str(tmp_path / "few.parquet"))
    with pytest.raises(ValueError, match="missing columns: y, z"):
        formats.read_frames(spark, str(tmp_path / "few.parquet"))


def test_a_format_of_ones_own(spark):
    formats.register("grid", lambda s, path, most: pack(s.range(most or 4).selectExpr(f"'{path}' as traj_id", "cast(id as int) as frame", "1 as residue", "cast(id as double) as x", "0D as y", "0D as z")))
    try:
        assert formats.read_frames(spark, "a.grid").count() == 4 and formats.read_frames(spark, "b", "grid", 2).count() == 2 and "grid" in formats.formats()
        formats.register("grid", lambda s, path, most: s.range(1))
        with pytest.raises(ValueError, match="gives no traj_id"):
            formats.read_frames(spark, "a.grid")
    finally:
        formats._readers.pop("grid")
