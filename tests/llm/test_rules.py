import random

import numpy as np
import pytest

from residua.llm.rules import at_most, cutoff, cutoffs, measure, places, verdicts
from tests.llm import brute


def plain(text):
    text = text or ""
    w, seen, dup = brute.words(text), set(), 0
    for x in text.split("\n"):
        dup += x in seen and bool(brute.words(x))
        seen.add(x)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    hit = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_measures():
    rng = random.Random(6)
    for _ in range(400):
        t = "".join(rng.choice(["a", "b", "é ", " ", "\n", "\t", "\x0b", "#", "|", "a b c ", " ", "A"]) for _ in range(rng.randint(0, 60)))
        assert measure(t)[:5] == plain(t), repr(t)
    assert measure(None)[:5] == (0, 0, 0, 0, 0)
    assert measure("w " * 100_000)[4] == 100_000


def test_exact_bounds():
    from math import comb

    for k, n, p in ((0, 10, 0.1), (3, 20, 0.2), (20, 20, 0.5), (0, 2000, 0.003)):
        assert at_most(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    good = np.zeros(11, dtype=np.int64)
    good[2] = 2000
    assert cutoff(good, 0.01, 0.05) == 2
    assert cutoff(good // 100, 0.01, 0.05) is None  # 20 texts guarantee nothing


def test_cutoffs_keep_their_promise():
    rng, broken = np.random.default_rng(5), 0
    shares = np.array([0.7, 0.2, 0.06, 0.025, 0.015])
    for _ in range(300):
        g = cutoff(rng.multinomial(800, shares), 0.05, 0.1)
        broken += g is not None and shares[g + 1 :].sum() > 0.05
    assert broken / 300 <= 0.1 + 3 * (0.1 * 0.9 / 300) ** 0.5


def test_operator(spark):
    rng = random.Random(8)
    clean = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60))
    rows = [(k, clean(), "en", 1) for k in range(3000)] + [(3000 + k, clean().replace(" ", " ## "), "en", 0) for k in range(50)]
    rows += [(4000, None, "en", 0), (4001, "", None, 0), (4002, "a b c " * 40, "en", 0), (4003, clean(), None, 1), (4003, clean(), None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, kept int")
    labels = spark.createDataFrame([(i, int(i < 3000), 0) for i, *_ in rows if i < 3050], "doc_id bigint, quality int, toxic int")
    x, names = verdicts(docs, labels)
    got = {}
    for r in x.collect():
        got.setdefault(r["doc_id"], []).append((r[names["base_failed"]], r[names["kept"]]))
    assert sum(not k for i in range(3000) for _, k in got[i]) <= 30
    assert all(got[3000 + k] == [(False, False)] for k in range(50))
    assert got[4000] == got[4001] == got[4002] == [(True, False)] and got[4003] == [(False, True)] * 2
    assert verdicts(docs.limit(0), labels)[0].count() == 0
    y, names = verdicts(docs.filter("doc_id between 2990 and 3010"), labels.limit(0))
    assert y.filter(names["kept"]).count() == 21  # nothing is guaranteed, so nothing goes


def test_places():
    assert [places(n, 0.01, 0.05 / t) for n, t in ((298, 1), (299, 1), (436, 4), (437, 4))] == [0, 1, 0, 1]
    for n, alpha, delta in ((2000, 0.01, 0.05), (800, 0.05, 0.1), (50, 0.5, 0.9), (3, 0.9, 0.9), (0, 0.01, 0.05)):
        assert places(n, alpha, delta) == sum(at_most(k, n, alpha) <= delta for k in range(n))
    good = {"a": np.array([100, 0, 0]), "b": np.array([90, 7, 3]), "c": np.array([50, 30, 20])}
    assert [cutoffs(good, k) for k in (0, 1, 3, 12, 1000)] == [{}, {"a": 0}, {"a": 0, "b": 2, "c": 2}, {"a": 0, "b": 1, "c": 2}, {"a": 0, "b": 0, "c": 0}]


def test_rules_together_keep_their_promise():
    rng, broken, found = np.random.default_rng(7), 0, 0
    combos = rng.integers(0, 11, (400, 3)) * (rng.random((400, 3)) < 0.2)
    p = rng.dirichlet(np.full(400, 0.5))
    for _ in range(300):
        own = np.repeat(combos, rng.multinomial(800, p), axis=0)
        cells = cutoffs({r: np.bincount(own[:, r], minlength=11) for r in range(3)}, places(800, 0.05, 0.1))
        found += len(cells)
        broken += p[(combos > np.array([cells.get(r, 10) for r in range(3)])).any(axis=1)].sum() > 0.05
    assert found == 900 and broken / 300 <= 0.1 + 3 * (0.1 * 0.9 / 300) ** 0.5


def test_strata_with_few_labels(spark):
    rng = random.Random(9)
    clean = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60))
    rows = [(k, clean(), lang) for k, lang in enumerate(["en"] * 500 + ["es"] * 40)]
    rows += [(1000 + k, clean().replace(" ", " ## "), lang) for k, lang in enumerate(["en", "es", "fr", None])] + [(2000, clean(), "fr")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in rows if i < 1000], "doc_id bigint, quality int")
    x, names = verdicts(docs, labels)
    got = {r["doc_id"]: (r[names["kept"]], r[names["failed_rules"]]) for r in x.collect()}
    assert all(got[1000 + k] == (False, "symbols") for k in range(4)), got
    assert got[2000] == (True, "") and sum(not kept for i, (kept, _) in got.items() if i < 1000) <= 5


def slow_verdicts(rows, good_ids, alpha, delta):
    """failed rules of each row (id, text, stratum), in plain Python: measures, strata, places dealt one by one, cutoffs by sorting."""
    import math

    kinds = ["symbols", "repeats", "dup_lines", "upper", "bangs", "long_words"]

    def cells(text):
        t = text or ""
        n, chars, symbols, dup, repeats = plain(t)
        share = lambda a, b: min(1.0, a / b) if b else 0.0
        v = [share(symbols, chars), share(repeats, n), share(dup, len(t.split("\n"))), share(sum("A" <= c <= "Z" for c in t), chars), share(t.count("!"), n), share(chars, n * 40)]
        return {k: math.floor(x * 200) for k, x in zip(kinds, v, strict=True)}

    def bound(n, limit):
        k = 0
        while k < n and sum(math.comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(k + 1)) <= limit:
            k += 1
        return k

    def cuts(good, k):
        down = {r: sorted((g[r] for g in good), reverse=True) for r in kinds}
        own = dict.fromkeys(kinds, 0)
        able = lambda r: own[r] < len(good) and not (own[r] and down[r][own[r] - 1] == 0)
        while k and any(map(able, kinds)):
            for r in kinds:
                if k and able(r):
                    own[r], k = own[r] + 1, k - 1
        return {r: down[r][j - 1] for r, j in own.items() if j}

    strata = {}
    for i, text, s in {(text, s): (i, text, s) for i, text, s in rows if i in good_ids}.values():
        strata.setdefault(s or "", []).append(cells(text))
    order = sorted(strata, key=lambda s: (-len(strata[s]), s))
    k = 0
    while k < len(order) and bound(len(strata[order[k]]), delta / (k + 2)):
        k += 1
    pool = order[k:]
    if not bound(sum(len(strata[s]) for s in pool), delta / (k + 1)):
        pool = order
    together = [g for s in pool for g in strata[s]]
    found = {s: cuts(strata[s], bound(len(strata[s]), delta / (k + 1))) for s in order[:k]}
    rest = cuts(together, bound(len(together), delta / (k + 1)))
    return [[r for r in kinds if cells(t)[r] > found.get(s or "", rest).get(r, 200)] for _, t, s in rows]


@pytest.mark.parametrize("sizes", [(400, 300, 20, 15), (30, 20, 10, 5), (500, 0, 0, 3)])
def test_verdicts_by_brute_force(spark, sizes):
    rng = random.Random(sum(sizes))
    word = lambda: "".join(rng.choice("abcdefghABC!") for _ in range(rng.choice([3, 4, 9])))
    text = lambda: "".join(rng.choice([" ", " ", " ", "\n"]) + rng.choice([word(), "#", "the same"] if rng.random() < 0.2 else [word()]) for _ in range(rng.randint(50, 70)))
    rows = [(k, text(), s) for k, s in enumerate(s for s, n in zip(("en", "de", None, ""), sizes, strict=True) for _ in range(n))]
    rows += [(10_000 + k, rng.choice([text(), text().replace(" ", " # "), text() * 3, text().upper(), ""]), rng.choice(["en", "de", "fr", None])) for k in range(150)] + [(20_000, rows[0][1], "en"), (20_001, None, "en")]
    good = {r[0] for r in rows if r[0] < 10_000 or r[0] == 20_000}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in good] + [(i, 0) for i in range(10_000, 10_050)], "doc_id bigint, quality int")
    x, names = verdicts(docs, labels, alpha=0.05, delta=0.2)
    got = {r["doc_id"]: (r[names["failed_rules"]], r[names["kept"]]) for r in x.collect()}
    for (i, t, _), failed in zip(rows, slow_verdicts(rows, good, 0.05, 0.2), strict=True):
        n, _, _, _, repeats = plain(t or "")
        assert got[i] == (",".join(failed), not failed and n >= 50 and 100 * repeats <= 50 * n), i
    assert any(f for f, _ in got.values())
