import random
import re
from math import log2

import pytest

from residua.llm import op11
from residua.llm.guesses import LONGEST_BASE, Guesses, brute_bits
from residua.llm.secretscan import ACCESS, ASSIGN, ASSIGN_STEMS, CONTEXT, CONTEXT_STEMS, HEX, KINDS, common_words, found, lower, matches, ranks, scan_secrets
from tests.llm import brute

WORDS = ["the", "correct", "horse", "battery", "staple", "there", "hunter", "token", "here", "summer"]
GUESSES = Guesses(ranks(WORDS))
PIECES = ["pass", "word", "passwd", "PASSWORD", "token", "Secret", "api_key", "APIKEY", "=", ":", " ", "'", '"', "abc", "x9Qz", "hunter22", "K", "ſ", "İ", "is ", "\n", "=>", "key", "pin", "pw", "login", "`", "AKIA", "ABCDEFGH0123", "0123456789ab", "deadbeef", "é"]


def base(text):
    """The base spans as the contract has them."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 6:
            out.append(("assign", m.start(), m.end()))
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def cheapest(g, value):
    """The minimum over all cuts, by trying every cut."""

    def tried(i, first):
        if i == len(value):
            return 0.0
        ends = {}

        def put(end, bits):
            ends[end] = min(bits, ends.get(end, 1e9))

        spelled = 0.0
        for k in range(i, len(value)):
            spelled += brute_bits(value[k])
            put(k + 1, spelled)
        plain = value.translate(__import__("residua.llm.guesses", fromlist=["UNSHIFT"]).UNSHIFT)
        for end, bits in [*g.words(value, i), *g.dates(value, i), *g.walks(value, plain, i)]:
            put(end, bits)
        for p in range(1, LONGEST_BASE + 1):
            part, times = value[i : i + p], 1
            while len(part) == p and value[i + times * p : i + (times + 1) * p] == part:
                times += 1
            if times > 1:
                put(i + times * p, g.bits(part, repeats=False) + log2(times))
        return min(bits + (0 if first else 1) + tried(end, False) for end, bits in ends.items())

    return tried(0, True)


def test_cheapest_cut():
    rng = random.Random(4)
    parts = ["a", "b", "9", "#", "the", "Sum", "summer", "1987", "qwe", "ab", "T0", "é"]
    for _ in range(300):
        value = "".join(rng.choice(parts) for _ in range(rng.randint(0, 4)))[:9]
        assert GUESSES.bits(value) == pytest.approx(cheapest(GUESSES, value)), value


def test_costs():
    cost = {v: GUESSES.bits(v) for v in ("", "password", "P@ssw0rd", "changeme", "qwertyuiop", "1234567890", "a" * 40, "12/05/1987", "19870512", "Summer2024!", "drowssap", "token_here", "xK9fQ2zLw77", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")}
    assert [v for v, c in cost.items() if c >= log2(1e10)] == ["xK9fQ2zLw77", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"]
    assert cost[""] == 0 and cost["password"] < cost["P@ssw0rd"] and cost["12/05/1987"] == cost["19870512"] + 2
    assert GUESSES.bits("hunter2") < GUESSES.bits("hunTer2") < GUESSES.bits("hunqer2")
    assert GUESSES.bits("aB3$" * 30_000) < 40 and GUESSES.bits("x9" + "q7" * 9 + "zz3" * 5_000) > 20  # long values, in linear time


def test_base_spans_against_the_patterns_as_given():
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))
        got = [s[:3] for s in found(text, GUESSES, 1e10) if s[0] != "guess"]
        assert got == base(text), text
        low = lower(text)
        for pattern, stems in ((ASSIGN, ASSIGN_STEMS), (CONTEXT, CONTEXT_STEMS)):
            assert [m.span() for m in matches(pattern, text, low, stems)] == [m.span() for m in pattern.finditer(text)], text
    assert ACCESS.findall("AKIAAKIA" + "B" * 16) == ["AKIAAKIA" + "B" * 16] and HEX.findall("f" * 23 + "g" + "0" * 24) == ["0" * 24]


def test_context():
    guess = lambda t: [t[s:e] for kind, s, e, _ in found(t, GUESSES, 1e10) if kind == "guess"]
    assert guess('my passphrase is "Xk quel 99 !zor" now') == ["Xk quel 99 !zor"]
    assert guess("passcode is xK9fQ2zLw77, thanks. password is unbelievablylongish") == ["xK9fQ2zLw77"]
    assert guess("DB_PASSWORD=hunter2 token=changeme pwd: 'qwertyuiop' login: 12/05/1987") == []
    assert guess("private-key -> zX!8kq%Lp2v) and bypass: zX!8kq%Lp2v") == ["zX!8kq%Lp2v"]
    assert guess("xK9fQ2zLw77 24be64439e3e49cf46b2d7c90f3602a3d0b907ff") == []  # no context
    assert guess("é token: xK9fQ2zLw77") == ["xK9fQ2zLw77"]


def test_words_of_the_corpus(spark):
    rows = [("the The, the. x1 cat",), ("the cat a%sb dog " % chr(9),), (None,), ("",), ("zebra " * 5 + "w" * 30,)]
    docs = spark.createDataFrame(rows, "text string")
    assert common_words(docs, most=3) == ["zebra", "the", "cat"] and common_words(docs) == ["zebra", "the", "cat"]
    assert common_words(docs.limit(0)) == []


def test_operator(spark):
    rows = [(1, None, 1), (2, "", 2), (None, "token=xK9fQ2zLw77", 3), (None, None, 4), (5, "secret=token:abcdefgh", 5), (6, "\U0001f600 api_key: \"AKIA" + "Z9" * 10 + "\"", 6), (6, "\U0001f600 api_key: \"AKIA" + "Z9" * 10 + "\"", 6), (7, "pad " * 50_000 + "password = '" + "0123456789abcdef" * 2 + "'", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, Secrets int")
    x, names = scan_secrets(docs, words=WORDS)
    assert "Secrets" in x.columns and names["secrets"].lower() != "secrets"
    got = [(r["doc_id"], r["text"], [tuple(s)[:3] for s in r[names["secrets"]]]) for r in x.collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, t, [s[:3] for s in found(t, GUESSES, 1e10)])) for i, t, _ in rows)
    assert {i: s for i, _, s in got}[6] == [("assign", 2, 36), ("access", 12, 36)]  # a repeated pair is soon guessed
    assert scan_secrets(docs.limit(0))[0].count() == 0


def test_query(spark):
    rows = spark.read.parquet(f"{brute.SF}/documents.parquet").select("doc_id", "text").collect()
    counts = {}
    for r in rows:
        for w in re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "")):
            w = re.sub(r"[.,;:!?]$", "", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w))
            if re.fullmatch("[a-z]{3,20}", w):
                counts[w] = counts.get(w, 0) + 1
    g = Guesses(ranks(sorted(counts, key=lambda w: (-counts[w], w))[:20_000]))
    want = []
    for r in rows:
        own = base(r["text"] or "")
        text = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        every = sorted([*own, *(s[:3] for s in found(r["text"], g, 1e10) if s[0] == "guess")], key=lambda s: (s[1], KINDS.index(s[0])))
        want.append((r["doc_id"], *(sum(s[0] == k for s in own) for k in KINDS[:3]), brute.sha(text(own)), text(every)))
    got = op11.query(spark, brute.SF).collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted(want) and got[0].asDict().keys() >= {"n_assign", "n_access", "n_hex", "base_sha256", "spans"}
