"""Language identification and the quality classifier: held-out accuracy and defined cases."""

import numpy as np
import pytest

from residua.llm import classifier as c
from residua.llm import languages as g
from residua.llm import op1, op9
from tests.llm import brute


@pytest.fixture(scope="module")
def small(spark):
    return "/root/testdata/sf0.01"


def test_language_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    x = op1.query(spark, small).join(docs.select("doc_id", "lang"), "doc_id").filter("lang is not null").toPandas()
    held = x[x.held_out]
    assert len(x) == docs.count() and len(held) > 100
    assert (held.lang_pred == held.lang).mean() > 0.97 and held.score.between(0, 1).all()


def test_language_cases(spark):
    model = g.train([b"the cat and the dog of the house " * 3, b"der hund und die katze im haus " * 3] * 40, ["en", "de"] * 40)
    texts = [None, "", "123 ...", "the dog and the cat", "die Katze und der Hund", "the cat " * 40_000]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts * 2)], "doc_id bigint, text string, score int")
    x, names = g.identify(docs, model)
    got = {r["doc_id"]: (r[names["lang_pred"]], r[names["score"]]) for r in x.collect()}
    assert names["score"] != "score" and [got[k][0] for k in range(6)] == ["und", "und", "und", "en", "de", "en"]
    assert all(got[k] == got[k + 6] for k in range(6)) and got[0][1] == 0.0 and got[3][1] > 0.5
    assert g.identify(docs.limit(0), model)[0].count() == 0
    none = g.fit(spark.createDataFrame([(1, "a", None)], "doc_id bigint, text string, lang string"))
    assert {r[names["lang_pred"]] for r in g.identify(docs, none)[0].collect()} == {"und"}


def test_language_counts_do_not_depend_on_the_batch():
    blobs = [b"", b"a", b"ab", "größe".encode(), b"x" * 3000]
    alone = np.concatenate([g.grams([b]) for b in blobs])
    assert np.array_equal(g.grams(blobs), alone) and alone[1].sum() == 3  # " a", "a ", " a "


def test_quality_accuracy(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    x = op9.query(spark, small).join(labels, "doc_id").toPandas()
    held = x[x.held_out]
    good, bad = held[held.quality == 1], held[held.quality == 0]
    assert (good.predicted == 1).mean() > 0.97 and (bad.predicted == 0).mean() > 0.7


def test_network_is_one_function_of_the_text(monkeypatch):
    rng = np.random.default_rng(0)
    net = c.Network.new(rng)
    blobs = [bytes(rng.integers(97, 105, n).astype(np.uint8)) for n in (0, 1, 8, 9, 511, 512, 520, 9000)]
    whole, alone = net.logits(blobs), np.concatenate([net.logits([b]) for b in blobs])
    monkeypatch.setattr(c, "PART", 1024)
    assert np.allclose(whole, alone, atol=1e-5) and np.allclose(whole, net.logits(blobs), atol=1e-5)


def test_gradients():
    rng = np.random.default_rng(1)
    net, y = c.Network.new(rng), np.array([1.0, 0.0, 1.0])
    blobs = [bytes(rng.integers(97, 105, n).astype(np.uint8)) for n in (400, 900, 1500)]
    loss = lambda: float(-(y * np.log(p := c.sigmoid(net.logits(blobs))) + (1 - y) * np.log(1 - p)).mean())
    for p, d in zip(net.parameters(), c.gradients(net, blobs, y), strict=True):
        at = np.unravel_index(np.abs(d).argmax(), d.shape)
        kept = p[at]
        p[at] = kept + 5e-3
        up = loss()
        p[at] = kept - 5e-3
        slope, p[at] = (up - loss()) / 1e-2, kept
        assert slope == pytest.approx(d[at], rel=0.1, abs=1e-4)


def test_quality_cases(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "text", 0), (3, "text", 0), (4, "y" * 300_000, 0)], "doc_id bigint, text string, predicted int")
    net = c.fit(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    x, names = c.scored(docs, net)
    assert {r[names["predicted"]] for r in x.collect()} == {1} and names["predicted"] != "predicted"
    assert c.scored(docs.limit(0), net)[0].count() == 0
    other = c.Network.new(np.random.default_rng(2))
    rows = c.scored(docs, other)[0].collect()
    assert all(0 <= r[names["score"]] <= 1 for r in rows) and len({r[names["score"]] for r in rows if r["doc_id"] < 3}) == 1 and brute.SF


def slow_language(model, text):
    """Probabilities by the definition: counts of hashed n-grams, their average, a linear softmax."""
    data, n = b" " + text.lower().encode() + b" ", {}
    for size in g.GRAMS:
        for k in range(len(data) - size + 1):
            h = data[k] * 0x9E3779B1 % 2**32
            for j in range(1, size):
                h = (h ^ data[k + j]) * 0x85EBCA6B % 2**32
            code = ((h ^ (h >> 15)) * 0xC2B2AE35 % 2**32 >> 19) % g.BUCKETS
            n[code] = n.get(code, 0) + 1
    z = model.bias.astype(float) + sum(v * model.weights[code].astype(float) for code, v in n.items()) / sum(n.values())
    e = np.exp((z - z.max()) / model.temperature)
    return e / e.sum()


def test_languages_by_definition(spark, small):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    model = g.fit(docs)
    x, names = g.identify(docs, model)
    for r in x.limit(80).collect():
        if r["text"] and g.LETTER.search(r["text"]):
            p = slow_language(model, r["text"])
            assert r[names["score"]] == pytest.approx(p.max(), abs=1e-4) and p[model.classes.index(r[names["lang_pred"]])] == pytest.approx(p.max(), abs=1e-4)
            assert r[names["accepted"]] == (r[names["score"]] >= model.least)


def slow_quality(net, text):
    """The probability by the definition, window by window and chunk by chunk."""
    data = text.encode()
    n = max(1, -(-len(data) // c.BLOCK))
    byte = lambda k: data[k] if 0 <= k < len(data) else 0xFF

    def block(b):
        own = range(b * c.BLOCK, (b + 1) * c.BLOCK)
        lags = [sum(byte(k) != 0xFF and k >= lag and byte(k) == byte(k - lag) for k in own) / c.BLOCK for lag in range(1, c.LAGS + 1)]
        return np.concatenate([*(net.embed[byte(k)] for k in own), lags])

    seen = [block(b) for b in range(n + 1)]
    answers = [seen[b] @ net.conv[0] + seen[b + 1] @ net.conv[1] + net.conv_bias for b in range(n)]
    starts = [0] if n <= c.CHUNK else [s for s in range(0, n, c.STRIDE) if s + c.CHUNK - c.STRIDE < n]
    features = [np.maximum(np.max(answers[s : s + c.CHUNK], axis=0), 0) for s in starts]
    pooled = np.concatenate([np.max(features, axis=0), np.mean(features, axis=0)])
    z = np.tanh(pooled @ net.hidden + net.hidden_bias) @ net.out + net.out_bias[0]
    return 1 / (1 + np.exp(-z))


def test_quality_by_definition(spark, monkeypatch):
    monkeypatch.setattr(c, "PART", 1024)  # long texts go in parts
    rng = np.random.default_rng(3)
    net = c.Network.new(rng)
    texts = ["".join(rng.choice(list("abc de\n")) for _ in range(n)) for n in (1, 7, 8, 9, 255, 256, 511, 512, 513, 768, 769, 1024, 1025, 1300, 2500, 5000)] + ["aé漢" * 300]
    assert c.sigmoid(net.logits([t.encode() for t in texts])) == pytest.approx([slow_quality(net, t) for t in texts], abs=1e-4)


def test_samples_of_null_and_repeated_ids(spark):
    from residua.llm.common import bounded_sample

    rows = [(None, f"the cat and the dog {k}", "en") for k in range(300)] + [(5, f"le chat et le chien {k}", "fr") for k in range(300)] + [(k, f"der hund und die katze {k}", "de") for k in range(300)]
    rows += [(9, "una sola", "es")] * 200 + [(None, None, "en"), (1, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)
    assert g.fit(docs, per_class=100).classes == ["de", "en", "es", "fr"]
    x = bounded_sample(docs.filter("text is not null"), "lang", ["doc_id", "text"], 100)
    assert {r["lang"]: r["count"] for r in x.groupBy("lang").count().collect()} == {"de": 100, "en": 100, "fr": 100, "es": 1}
    again = bounded_sample(docs.filter("text is not null").repartition(3), "lang", ["doc_id", "text"], 100)
    assert sorted(map(str, x.collect())) == sorted(map(str, again.collect())) and x.columns == docs.columns
    assert {r["lang"] for r in bounded_sample(docs, "lang", ["doc_id", "text"], 100, classes=2).collect()} == {"de", "en"}
    assert bounded_sample(docs.limit(0), "lang", ["doc_id"], 100).count() == 0


def test_classifier_sees_bounded_rows(spark, monkeypatch):
    seen, train = [], c.train
    monkeypatch.setattr(c, "train", lambda blobs, labels, share: seen.append((len(blobs), labels.tolist().count(1), share)) or train(blobs, labels, share))
    docs = spark.createDataFrame([(k % 2, f"text {k}") for k in range(900)] + [(1, "text 1")] * 50 + [(None, "none")] * 50 + [(3, None)], "doc_id bigint, text string")
    c.fit(docs, spark.createDataFrame([(0, 0), (1, 1), (1, 0), (3, 1), (None, 1), (4, None), (5, 7)], "doc_id bigint, quality int"), per_class=60)
    assert seen == [(120, 60, 2 / 3)]


def test_few_rows_of_a_class_are_ranked(spark):
    """Of a class of any size the window gets a few times the sample, and the sample is that of the smallest hashes."""
    from pyspark.sql import functions as F

    from residua.llm.common import bounded_sample

    docs = spark.range(40_000).select("id", F.when(F.col("id") < 20_000, "a").when(F.col("id") < 39_000, "b").otherwise("c").alias("kind"))
    x = bounded_sample(docs, "kind", ["id"], 20)
    hashed = docs.withColumn("h", F.xxhash64("id")).collect()
    want = {r["id"] for k in "abc" for r in sorted((r for r in hashed if r["kind"] == k), key=lambda r: r["h"])[:20]}
    assert {r["id"] for r in x.collect()} == want
    near = [r for r in hashed if r["h"] / 2**64 + 0.5 <= (4 * 20 + 200) / {"a": 20_000, "b": 19_000, "c": 1_000}[r["kind"]]]
    assert 3 * 200 < len(near) < 3 * 400
