"""Files in, files out: the classes, functions and commands; and the registered queries."""

import struct
import zlib

import pytest

from residua import api
from residua.__main__ import main
from tests.test_operators import MAP, P


@pytest.fixture
def files(tmp_path):
    lines = []
    for f, coords in P.items():
        lines.append(f"MODEL {f}")
        lines += [f"ATOM  {r:5d}  CA  ALA A{r:4d}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00" for r, (x, y, z) in coords.items()]
        lines.append("ENDMDL")
    (tmp_path / "t.pdb").write_text("\n".join(lines) + "\n")
    (tmp_path / "c.csv").write_text("i,j,r6,r12,r,cluster\n" + "".join(f"{i},{j},1,1,{r},{c}\n" for _, i, j, r, c in MAP))
    (tmp_path / "raw.cont").write_text("".join(f"{i} {j} 2.0 0.6\n" for i, j in [(1, 10), (1, 11), (2, 12), (2, 13), (3, 13), (20, 30)]))
    return tmp_path


def test_trajectory(spark, files):
    t = api.Trajectory(spark, str(files / "t.pdb"), str(files / "c.csv"))
    t.read_trajectory()
    assert (files / "t_parsed.csv").read_text() == ('frame,contacts,q,contact_list,clusters_filling\n1,2,0.5,"[(1, 4), (2, 5)]","{0: 0, 1: 1, 2: 0}"\n'
                                                     '2,2,0.5,"[(2, 5), (2, 6)]","{0: 1, 1: 0.5, 2: 0}"\n3,0,0,[],"{0: 0, 1: 0, 2: 0}"\n')
    order = t.parse(window_size=1, animate=True)
    assert order == [1] and (files / "t_class.txt").read_text() == "1\n"
    assert (files / "t_summary.csv").read_text() == "frame,cluster_0,cluster_1,cluster_2\n1,0,1,0\n2,1,0.5,0\n3,0,0,0\n"
    assert (files / "t_100_smoothed.csv").read_text().startswith("frame,q_smooth,cluster_0_smooth,cluster_1_smooth,cluster_2_smooth\n1,0.333")
    assert (files / "t_animation.gif").read_bytes()[:6] == b"GIF89a" and (files / "t_trajectory.svg").exists()
    with pytest.raises(ValueError):
        t.animate(output_format="avi")
    with pytest.raises(FileNotFoundError):
        api.Trajectory(spark, str(files / "t.pdb"), str(files / "none.csv"))


def test_functions(spark, files):
    pdb = str(files / "t.pdb")
    rows = api.read_trajectory(spark, pdb, str(files / "c.csv"), output_csv=str(files / "t_parsed.csv"))
    assert rows[1] == {"frame": 2, "contacts": 2, "q": 0.5, "contact_list": [(2, 5), (2, 6)], "clusters_filling": {0: 1.0, 1: 0.5, 2: 0.0}}
    assert api.smooth(spark, pdb, 1)[0] == {"frame": 1, "q_smooth": 0.5, "cluster_smooth": {"cluster_0_smooth": 0.0, "cluster_1_smooth": 1.0, "cluster_2_smooth": 0.0}}
    assert api.summarize_trajectory(spark, pdb, 2)[0] == {"frame": 1, "cluster_means": {"cluster_0": 0.5, "cluster_1": 0.75, "cluster_2": 0.0}}
    api.summarize_trajectory(spark, pdb, 1, 0.5)
    assert api.classify(spark, pdb) == [1]
    with pytest.raises(FileNotFoundError):
        api.smooth(spark, str(files / "other.pdb"))


def test_contact_map(spark, files):
    m = api.ContactMap(spark, str(files / "raw.cont"))
    assert len(m) == 6 and m.stats()["unassigned"] == 1
    saved = m.save(directory=str(files))
    assert open(saved).readline() == "i,j,r6,r12,r,cluster\n"
    again = api.ContactMap.of_csv(spark, saved)
    assert again.stats() == m.stats()
    points, svg = again.draw(directory=str(files))
    assert points.count() == 6 and open(svg).read().startswith("<svg")


def test_commands(spark, files, capsys, monkeypatch):
    monkeypatch.chdir(files)
    own = ["t.pdb", "--contacts", "c.csv"]
    assert main(["trajectory", "read", *own], spark) == 0
    for args in (["summarize", *own, "-w", "1", "--plot"], ["draw", *own], ["plot-summary", *own, "-w", "1", "--cutoff", "0.5"], ["animate", *own], ["classify", *own, "-w", "1"], ["classify", *own, "--summary-csv", "t_summary_binary_0.5.csv"], ["parse", *own, "-w", "1"]):
        assert main(["trajectory", *args], spark) == 0, (args, capsys.readouterr())
    assert main(["contacts", "parse", "raw.cont", "--output-name", "x"], spark) == 0
    assert main(["contacts", "draw", "results/x.csv"], spark) == 0
    assert main(["trajectory", "read", "none.pdb", "--contacts", "c.csv"], spark) == 1


def test_registered_queries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 500
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_animation_has_all_frames(spark, tmp_path):
    from residua.plans import figures

    frames = spark.range(1, 1204).selectExpr("cast(id as int) as frame").repartition(5)
    points = spark.createDataFrame([(1, 200, 100, 0), (1203, 200, 100, 0), (1203, 3, 1, 2)], "frame int, x int, y int, cluster int")
    data, at, images = open(figures.animation(points, frames, 200, str(tmp_path / "a.gif")), "rb").read(), 13 + 3 * 16, []
    while data[at] != 0x3B:
        start, at = at, at + {0x21: 2, 0x2C: 11}[data[at]]
        while data[at]:
            at += data[at] + 1
        at += 1
        images += [data[start:at]] * (data[start] == 0x2C)
    assert len(images) == 1203 and at == len(data) - 1
    assert len({images[0], images[1], images[-1]}) == 3 and set(images[1:-1]) == {images[1]}


def png_size(path):
    data, at, size = open(path, "rb").read(), 8, None
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    while at < len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        assert zlib.crc32(name + body) == struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]
        size = struct.unpack(">II", body[:8]) if name == b"IHDR" else size
        if name == b"IDAT":
            assert len(zlib.decompress(body)) % size[1] == 0
        at += 12 + n
    return size


def test_png_drawings_and_options(spark, files, monkeypatch, capsys):
    monkeypatch.chdir(files)
    own = ["t.pdb", "--contacts", "c.csv"]
    assert main(["trajectory", "parse", *own, "--window-size", "1", "--output-format", "png"], spark) == 0
    assert png_size("t_trajectory.png") == (900, 780) and png_size("t_summary.png") == (900, 420)
    assert main(["trajectory", "read", *own, "-o", "out/other.csv"], spark) == 0 and open("out/other.csv").read() == open("t_parsed.csv").read()
    assert main(["trajectory", "draw", *own, "--output-format", "svg", "--no-show"], spark) == 0
    assert main(["trajectory", "smooth", "t_parsed.csv", "-w", "1", "-o", "out/s.csv"], spark) == 0
    assert open("out/s.csv").read().splitlines()[:2] == ["frame,q_smooth,cluster_0_smooth,cluster_1_smooth,cluster_2_smooth", "1,0.5,0,1,0"]
    assert main(["trajectory", "smooth", "t_parsed.csv", "-w", "2"], spark) == 0 and (files / "t_parsed_2_smoothed.csv").exists()
    assert main(["trajectory", "plot-summary", *own, "--summary-csv", "t_summary.csv", "--cutoff", "0.5", "--no-show"], spark) == 0
    assert "|      1|      3|     2|" in capsys.readouterr().out  # cluster 1 is formed in 2 of 3 windows
    assert main(["contacts", "parse", "raw.cont", "--output-name", "x", "--no-show", "--output-format", "PNG"], spark) == 0
    assert png_size("results/plots/x.png")[0] > 600
    assert main(["trajectory", "animate", *own, "--output-format", "mp4", "--fps", "5"], spark) == 0 and (files / "t_animation.mp4").exists()


def atoms_in(data):
    at, out = 0, {}
    while at < len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        head = 8
        if n == 1:
            n, head = struct.unpack(">Q", data[at + 8 : at + 16])[0], 16
        out[name] = data[at + head : at + n]
        at += n
    assert at == len(data)
    return out


def test_movie_has_all_frames(spark, tmp_path):
    from residua.plans import figures

    frames = spark.range(1, 31).selectExpr("cast(id as int) as frame").repartition(5)
    points = spark.createDataFrame([(1, 200, 100, 0), (30, 200, 100, 0), (30, 3, 1, 2)], "frame int, x int, y int, cluster int")
    top = atoms_in(open(figures.movie(points, frames, 200, str(tmp_path / "a.mp4"), 10), "rb").read())
    assert list(top) == [b"ftyp", b"mdat", b"moov"]
    tables = top[b"moov"]
    for name in (b"trak", b"mdia", b"minf", b"stbl"):
        tables = atoms_in(tables)[name]
    tables = atoms_in(tables)
    n = struct.unpack(">I", tables[b"stsz"][8:12])[0]
    sizes = struct.unpack(f">{n}I", tables[b"stsz"][12:])
    assert n == 30 and sum(sizes) == len(top[b"mdat"]) and struct.unpack(">III", tables[b"stts"][4:]) == (1, 30, 1)
    assert struct.unpack(">Q", tables[b"co64"][8:])[0] == 8 + len(top[b"ftyp"]) + 16
    at, pictures = 0, []
    for k, size in enumerate(sizes):
        (tmp_path / "one.png").write_bytes(top[b"mdat"][at : at + size])
        pictures.append((tmp_path / "one.png").read_bytes())
        assert png_size(tmp_path / "one.png") == (201, 201), k
        at += size
    assert len({pictures[0], pictures[1], pictures[29]}) == 3 and set(pictures[1:29]) == {pictures[1]}


def test_commands_read_other_formats(spark, files, monkeypatch):
    monkeypatch.chdir(files)
    (files / "points.csv").write_text("frame,residue,x,y,z\n" + "".join(f"{f},{r},{x:.3f},{y:.3f},{z:.3f}\n" for f, coords in P.items() for r, (x, y, z) in coords.items()))
    own = ["--contacts", "c.csv", "-o"]
    assert main(["trajectory", "read", "t.pdb", *own, "a.csv"], spark) == 0 and main(["trajectory", "read", "points.csv", "--format", "csv", *own, "b.csv"], spark) == 0
    frames = [f for f, coords in P.items() if coords]  # a table has no row for a frame without points
    a, b = (files / "a.csv").read_text().splitlines(), (files / "b.csv").read_text().splitlines()
    assert b == [a[0], *(line for line in a[1:] if int(line.split(",")[0]) in frames)] and len(b) > 2
