import random

import pytest

from residua.llm.neardups import banding, components, deduplicated, near_duplicates
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, n int"


def compare(spark, rows, size, percent):
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], SCHEMA).repartition(3)
    key = lambda r: tuple((v is None, v or 0) for v in r)
    got = sorted((tuple(r) for r in near_duplicates(docs, shingle_words=size, percent=percent).collect()), key=key)
    assert got == sorted(brute.classes(rows, size, percent), key=key)


def cloud(rng, base, n, least, most):
    """Copies of a text with some of its words replaced."""
    out = []
    for _ in range(n):
        w = list(base)
        for k in rng.sample(range(len(w)), rng.randint(least, most)):
            w[k] = f"z{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_against_brute_force(spark, size, percent):
    rng = random.Random(size)
    base = [[f"v{rng.randint(0, 400)}" for _ in range(n)] for n in (120, 60, 200)]
    texts = [t for b, n in zip(base, (60, 20, 20), strict=True) for t in cloud(rng, b, n, 0, 5)]
    texts += [" ".join(base[0]).upper(), "\t".join(base[0]), " ".join(base[0]), "", "  \n", None, "one two", "One\ttwo", "one two three", "ünï", "ÜNÏ"]
    texts += [" ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 80))) for _ in range(40)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    compare(spark, list(zip(ids, texts, strict=True)), size, percent)


def test_null_and_repeated_ids(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    compare(spark, [(None, a), (5, a), (9, a), (9, b), (9, b), (2, b), (None, "x y z"), (None, "x y z"), (None, None)], 3, 85)


def test_large_group_in_blocks(spark, monkeypatch):
    import residua.llm.neardups as m

    for name, value in (("BLOCK", 8), ("SLICE_ROWS", 16), ("BROADCAST_ROWS", 10)):
        monkeypatch.setattr(m, name, value)
    rng = random.Random(11)
    base = [f"v{k}" for k in range(150)]
    rows = list(enumerate(cloud(rng, base, 150, 3, 14)))
    compare(spark, rows, 3, 85)


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_wide_buckets(spark, monkeypatch, size, percent):
    import residua.llm.neardups as m

    for name, value in (("BLOCK", 8), ("SLICE_ROWS", 16), ("WIDE", 1), ("CELLS", 512)):
        monkeypatch.setattr(m, name, value)
    rng = random.Random(size)
    word = lambda: f"u{rng.randint(0, 10**6)}"
    passage = [f"p{k}" for k in range(120)]
    rows = [" ".join(passage + [word() for _ in range(rng.randint(0, 24))]) for _ in range(90)]
    rows += [" ".join([word() for _ in range(n)] + passage[n:]) for n in range(0, 40, 3)]
    own = [word() for _ in range(16)]
    rows += cloud(rng, passage + own, 40, 1, 5) + cloud(rng, passage[:80] + own[:3], 30, 0, 4)
    met, keep = [], m._by_shingles

    def seen(*args):
        out = keep(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(m, "_by_shingles", seen)
    compare(spark, list(enumerate(rows)), size, percent)
    assert met


def test_texts_with_a_common_passage_meet_in_linear_number(spark, monkeypatch):
    import residua.llm.neardups as m

    met, keep = [], m._rest

    def seen(*args):
        out = m.cut(keep(*args))
        met.append(out.count())
        return out

    monkeypatch.setattr(m, "_rest", seen)
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(170)]
    for n in (500, 1500, 4500):
        texts = [" ".join(passage + [f"u{rng.randint(0, 10**9)}" for _ in range(20)]) for _ in range(n)]
        texts += [t + " more" for t in texts[: n // 10]]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        found = near_duplicates(docs, shingle_words=3, percent=85).collect()
        assert all(r["component_id"] == (r["doc_id"] if r["doc_id"] < n else r["doc_id"] - n) for r in found)
    assert met[1] <= 4 * met[0] + 1000 and met[2] <= 4 * met[1] + 1000


def test_empty_tables_and_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).count() == 0 and deduplicated(empty).columns == ["doc_id", "text", "n"]
    t = " ".join(map(str, range(30)))
    docs = spark.createDataFrame([(3, t, 1), (2, t, 2), (7, None, 3), (8, None, 4), (9, "w " * 100_000, 5)], SCHEMA)
    assert sorted(r["doc_id"] for r in deduplicated(docs).collect()) == [2, 7, 8, 9]


def test_banding():
    for t in (0.5, 0.8, 0.85, 0.95):
        rows, bands = banding(t)
        assert rows * bands <= 192 and (1 - t**rows) ** bands <= 1e-6 or t < 0.6


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(k, k + 1) for k in range(1000, 1030)] + [(5000, k) for k in range(5001, 5200)]
    parent = {}
    root = lambda k: k if parent.setdefault(k, k) == k else root(parent[k])
    for u, v in edges:
        if u != v:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {k: root(k) for k in parent}


def test_a_document_of_each_group_stays(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(9, a, 1), (12, a, 2), (2, b, 3), (9, b, 4), (9, a, 5), (None, a, 6), (9, None, 7), (12, "other", 8)]
    assert sorted(r["n"] for r in deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()) == [1, 3, 5, 6, 7, 8]


def test_many_null_and_repeated_ids(spark, monkeypatch):
    import residua.llm.neardups as m

    rng, joined, append = random.Random(6), [], m.append
    base = [f"v{k}" for k in range(120)]
    texts = [" ".join(base)] * 150 + cloud(rng, base, 250, 0, 4) + cloud(rng, [f"u{k}" for k in range(60)], 100, 0, 3)
    rows = [(None, t) for t in texts] + [(7, t) for t in texts[:120]] + [(k, t) for k, t in enumerate(texts[200:300], 100)]

    def counted(df, inputs, *rest, **more):
        if inputs == ["body", "node"]:
            joined.append(df.count())
        return append(df, inputs, *rest, **more)

    monkeypatch.setattr(m, "append", counted)
    compare(spark, rows, 3, 85)
    assert max(joined) < 10 * len(rows)  # null ids don't meet all pairs


def test_a_cluster_must_name_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from residua.llm.common import shared_dir

    made = []
    session = lambda master, path: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: path), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(session("spark://host:7077", None))
    assert shared_dir(session("spark://host:7077", "/shared")) == "/shared"
    made.clear()
    assert "residua-" in shared_dir(session("local[2]", None))
