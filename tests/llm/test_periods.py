import random
from zlib import crc32

import numpy as np
import pytest

from residua.llm import op12
from residua.llm.periods import Ends, automaton, periodic_runs, word_runs
from tests.llm import brute


def plain(w, least=12):
    """Every stretch of equal words q apart, for every q; of one stretch the smallest q counts."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        k = 0
        while k + q < len(w):
            start = k
            while k + q < len(w) and w[k] == w[k + q]:
                k += 1
            if k - start + q >= max(least, 2 * q):
                out.setdefault((start, k - start + q), q)
            k += 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def expected(doc_id, text):
    w = brute.words(text)
    n = len(w)
    if doc_id is not None and n and (h := crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a, before = g % n, list(w)
        p = 1 + (n - a) // (3 + g % 8)
        w = [before[i] if i < a else before[a + (i - a) % p] for i in range(n)]
    runs = plain(w)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, brute.sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), brute.sha(collapse(w, runs)))


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(3000):
        kinds, n = rng.choice([1, 2, 3, 4, 30]), rng.randint(0, 80)
        w = [rng.randrange(kinds) for _ in range(n)]
        if rng.random() < 0.5 and n > 20:
            a, p = rng.randrange(n), rng.randint(1, 10)
            w = [w[i] if i < a or a + (i - a) % p >= n else w[a + (i - a) % p] for i in range(n)]
        for least in (12, rng.choice([2, 3, 5])):
            assert word_runs(np.array(w, dtype=np.int64), least) == plain(w, least), (w, least)
    f, g = [0], [0, 1]
    while len(g) < 600:
        f, g = g, g + f
    assert word_runs(np.array(g)) == plain(g)  # full of overlapping runs
    many = list(range(3000)) * 2 + [9] * 3000  # one period of 3000 beside one of 1, large numbers of words
    assert word_runs(np.array(many)) == [(0, 6000, 3000), (6000, 3000, 1)]


def test_long_repeats_take_near_linear_time():
    for q in (1, 7, 5000):
        assert word_runs(np.arange(60_000) % q) == [(0, 60_000, q)]


def test_automaton_and_ordered_set():
    rng = random.Random(2)
    for _ in range(200):
        w = [rng.randrange(3) for _ in range(rng.randint(0, 25))]
        length, link, end = automaton(w)
        sets = {}
        for e in range(len(w)):
            state = end.index(e)
            while state > 0:
                sets.setdefault(state, set()).add(e)
                state = link[state]
        for state, ends in sets.items():  # a state's longest word ends exactly there
            e, n = min(ends), length[state]
            assert ends == {k for k in range(n - 1, len(w)) if w[k - n + 1 : k + 1] == w[e - n + 1 : e + 1]}
    own, near = list(range(3000)), Ends(1500)
    own.remove(1500)
    rng.shuffle(own)
    have = [1500]
    for x in own:
        got = near.add(x)
        assert got == (max((h for h in have if h < x), default=None), min((h for h in have if h > x), default=None)) if x % 10 == 0 else True
        have.append(x)
    assert list(near) == list(range(3000)) and near.n == 3000


def test_operator(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    rows = [(1, None, 1), (2, "", 2), (3, " \n\t", 3), (None, "x y " * 20, 4), (None, None, 5), (5, "a b c d e f g h i j k l " * 3 + "tail", 6), (5, "a b c d e f g h i j k l " * 3 + "tail", 6), (7, " é " * 30, 7), (8, say(3000) + " z" * 5000, 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, RUNS int")
    x, names = periodic_runs(docs)
    assert "RUNS" in x.columns and names["runs"] not in docs.columns
    got = sorted(((r["doc_id"] or 0, r["text"] or "", r[names["n_words"]], [tuple(v) for v in r[names["runs"]]], r[names["collapsed_text"]]) for r in x.collect()))
    want = []
    for i, t, _ in rows:
        w = brute.words(t)
        runs = plain(w)
        want.append((i or 0, t or "", len(w), runs, collapse(w, runs)))
    assert got == sorted(want)
    assert got[-1][3][-1][1:] == (5000, 1)
    assert periodic_runs(docs.limit(0))[0].count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs, least=1)


def test_query(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    got = {tuple(r) for r in op12.query(spark, brute.SF).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert got == {expected(r["doc_id"], r["text"]) for r in rows} and len(got) == len(rows)
    assert sum(r[1] > 0 for r in got) >= len(rows) // 20


def test_query_on_unusual_rows(spark, tmp_path):
    rows = [(10, None), (None, "a " * 40), (3, "one"), (3, "one"), (3, "b c " * 30), (40, ""), (27, "w " * 11), (28, "w " * 12)] + [(k, " ".join(f"v{k % 5}{j}" for j in range(k))) for k in range(100, 140)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(repr, (tuple(r) for r in op12.query(spark, str(tmp_path)).collect())))
    assert got == sorted(repr(expected(*r)) for r in rows)
