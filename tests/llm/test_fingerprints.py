import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from residua.llm import fingerprints as m
from tests.llm import brute


def slow(blob):
    """Selected windows by definition."""
    n = len(blob) - m.WINDOW + 1
    if n <= 0:
        return None
    code = []
    for p in range(n):
        w = blob[p : p + m.WINDOW]
        t = sum(int(m.CLOGC[w.count(b)]) for b in set(w))
        code.append(None if t > m.WEAK else (-abs(t - m.USUAL), p))
    wins = {}
    for s in range(1 - m.RUN, n):
        if own := [code[p] for p in range(max(0, s), min(n, s + m.RUN)) if code[p]]:
            wins[min(own)[1]] = wins.get(min(own)[1], 0) + 1
    return [p for p in sorted(wins) if wins[p] >= m.MIN_WINS]


def texts(seed, n):
    rng = random.Random(seed)
    return [bytes(rng.choice(b"abcdefgh ijkl\n  THE") for _ in range(rng.choice([0, 1, 63, 64, 65, 150, 400]))) for _ in range(n)]


def test_features_by_definition():
    blobs = [*texts(1, 40), b"a" * 300, b"ab" * 200, "é".encode() * 100]
    for blob, got in zip(blobs, m.features(blobs), strict=True):
        if (p := slow(blob)) is not None:
            assert len(got) == 1 if not p else got.tolist() == m._hash(np.frombuffer(b"".join(blob[i : i + 64] for i in p), np.uint8).reshape(-1, 64)).tolist()


def test_texts_without_a_selected_window_differ():
    blobs = [b"a" * 1000, b"b" * 5000, b"a" * 999, b"z" * 300_000, b"", b"a" * 1000]
    d = [m.digest(f) for f in m.features(blobs)]
    assert len({m.text_of(x) for x in d}) == 5 and m.likeness(d[0], d[5]) == 1
    assert all(m.likeness(d[i], d[j]) < 0.5 for i in range(5) for j in range(i))


def test_long_texts_in_pieces(monkeypatch):
    blob = b"".join(texts(2, 200))
    whole = m.features([blob])[0]
    monkeypatch.setattr(m, "PIECE", 700)
    assert np.array_equal(m.features([b"x", blob, b""])[1], whole) and len(whole) > 300


def test_likeness():
    d = [m.digest(f) for f in m.features([b"".join(texts(s, 60)) for s in (3, 4)])]
    assert m.likeness(d[0], d[0]) == 1 and m.likeness(d[0], d[1]) < 0.05
    assert m.likeness(d[0][:0], d[0]) == 0 and m.likeness(d[0][:0], d[0][:0]) == 1
    assert m.likeness(d[0], d[1]) == m.likeness(d[1], d[0])
    assert np.array_equal(m.digest_of(m.text_of(d[0])), d[0])


@pytest.mark.parametrize("ranges", [1, 3, 7])
def test_operator(spark, ranges):
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    rows = [(k * 3, prose(rng.choice([0, 1, 30, 200]))) for k in range(40)] + [(200, None), (201, ""), (202, "é漢😀" * 40), (203, "z" * 300_000), (None, prose(90))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, fingerprint string").repartition(4)
    got = {r["doc_id"]: r for r in m.fingerprints(docs, ranges=ranges).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        e = m.edited(t, after)
        assert len(e) == len(t) - len(t) // 3 + min(len(t) // 3, len(after))
        r = got[i]
        own, theirs, change = (m.digest(m.features([x.encode()])[0]) for x in (t, after, e))
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), brute.sha(e), m.text_of(own), m.text_of(change))
        assert r["near_edited"] == m.likeness(own, change) and r["near_next"] == m.likeness(own, theirs)
        assert not 150 < len(t) < 5000 or r["near_edited"] > 0.3


def test_ties_nulls_and_single_rows(spark):
    schema = "doc_id bigint, text string"
    one = m.fingerprints(spark.createDataFrame([(1, "abc")], schema)).first()
    assert one["edited_sha256"] == brute.sha("aba") and one["near_next"] == 1
    assert m.fingerprints(spark.createDataFrame([], schema)).count() == 0
    x = m.fingerprints(spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (None, "c"), (None, None)], schema)).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in x) == [(0, 0), (0, 1), (1, 1), (1, 1), (1, 1)]


def test_small_last_filters_count():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    full, few, others = h[:160], h[160:170], h[170:180]
    a, b = m.digest(np.r_[full, few]), m.digest(np.r_[full, others])
    assert 0.9 < m.likeness(a, b) < 0.97 and m.likeness(a, b) == m.likeness(b, a)
    assert m.likeness(a, m.digest(full)) == 1  # the shorter one is all there
    c = m.digest(np.r_[rng.integers(0, 1 << 63, 160, dtype=np.uint64), few])
    assert 0.02 < m.likeness(a, c) < 0.15
    assert m.likeness(m.digest(full[:150]), m.digest(np.r_[rng.integers(0, 1 << 63, 160, dtype=np.uint64), full[:1]])) < 0.1


def test_equal_and_null_ids_spread_over_ranges(spark):
    rows = [(None, f"text {k % 3} " * 30) for k in range(400)] + [(7, "seven " * 20)] * 300
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    x = m.in_ranges(docs, "doc_id", "text", 8)
    sizes = {r["part"]: r["n"] for r in x.filter("role = 1").groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert len(sizes) >= 6 and set(sizes.values()) == {1}
    got = m.fingerprints(docs, ranges=8).collect()
    after = {t: {brute.sha(m.edited(t, a)) for _, a in rows} for _, t in rows}
    assert len(got) == 700 and sum(r["doc_id"] is None for r in got) == 400
    own = {m.text_of(m.digest(m.features([t.encode()])[0])): t for t in after}
    assert all(r["edited_sha256"] in after[own[r["fingerprint"]]] for r in got)
    assert sum(r["near_next"] == 1 for r in got) >= 700 - 4  # equal rows follow each other
