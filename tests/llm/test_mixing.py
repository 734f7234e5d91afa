import random

from residua.llm.mixing import curriculum, mixed
from tests.llm import brute


def rows_of(frame, names):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r[names["size"]], r[names["source_size"]], round(r[names["target"]], 6), r[names["taken"]]) for r in frame.collect())


def check(spark, rows, **options):
    x, names = curriculum(spark.createDataFrame(rows, "doc_id bigint, text string, source string, extra int"), **options)
    expected = brute.mix([(i, len(brute.words(t)), s) for i, t, s, _ in rows])
    assert rows_of(x, names) == sorted((i is None, i or 0, *rest) for i, *rest in expected)
    return x, names


def test_random_tables(spark):
    rng = random.Random(1)
    for n, kinds in ((1, ["a"]), (40, ["a", "b", None]), (120, ["a", "B", "é", "a1", None])):
        check(spark, [(k, "w " * rng.choice([0, 1, 5, 300]), rng.choice(kinds), 0) for k in range(n)], buckets=rng.choice([1, 7, 64]))


def test_hot_source_nulls_and_repeated_rows(spark):
    rows = [(k, "a b c", "hot", 1) for k in range(60)] + [(1, "a b c", "hot", 1)] * 3 + [(None, None, None, None), (None, "x", "small", 2), (7, "", "small", 2)]
    x, names = check(spark, rows)
    for s in ("hot", "small"):
        own = x.filter(x["source"] == s).collect()
        assert abs(sum(r[names["taken"]] for r in own) - own[0][names["target"]]) <= 1


def test_empty_table_and_no_words(spark):
    schema = "doc_id bigint, text string, source string"
    assert curriculum(spark.createDataFrame([], schema))[0].count() == 0
    assert mixed(spark.createDataFrame([], schema)).count() == 0
    x, names = curriculum(spark.createDataFrame([(1, "", "a"), (2, None, None)], schema))
    assert {(r[names["target"]], r[names["taken"]]) for r in x.collect()} == {(0.0, 0)}


def test_clashing_names_and_order(spark):
    rows = [(k, "a b", "s" + str(k % 3), k, "z", 1.5) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int, `key` string, `po.sition` double")
    x, names = curriculum(docs)
    assert names["size"] != "size" and set(docs.columns) <= set(x.columns)
    out = mixed(docs)
    assert out.columns == docs.columns
    taken = {r["doc_id"]: r for r in x.collect()}
    seen = [r["doc_id"] for r in out.collect()]
    assert set(seen) == {i for i, r in taken.items() if r[names["taken"]] > 0} and max(map(seen.count, seen)) <= 2
    places = sorted((p, i) for i, r in taken.items() for p in r[names["position"]] if p is not None)
    assert seen == [i for _, i in places] and all(0 <= p <= 1 for p, _ in places)
    assert seen == [r["doc_id"] for r in mixed(docs.repartition(5)).collect()]  # reruns agree


def test_large_ranges_are_cut_once_more(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, None, 5, k]), "w " * rng.choice([0, 1, 4, 9]) + rng.choice("abcdef"), rng.choice(["a", "b"]), k) for k in range(300)]
    for buckets, most in ((4, 1), (1, 20), (64, 50)):
        x, names = curriculum(spark.createDataFrame(rows, "doc_id bigint, text string, source string, extra int").repartition(4), buckets=buckets, most=most)
        got = x.collect()
        whole, _ = curriculum(spark.createDataFrame(rows, "doc_id bigint, text string, source string, extra int"))
        key = lambda r: (r["source"], r["doc_id"] is None, r["doc_id"] or 0, r[names["size"]])
        total = lambda rs: {k: sum(r[names["taken"]] for r in rs if key(r) == k) for k in map(key, rs)}
        assert total(got) == total(whole.collect()) and len(got) == 300
        starts = {}
        for r in got:  # every word of a source has one place
            starts.setdefault(r["source"], []).append((r[names["position"]][0], r[names["size"]], r[names["taken"]]))
        for s, own in starts.items():
            assert abs(sum(t for *_, t in own) - next(r[names["target"]] for r in got if r["source"] == s)) <= 1
            places = [p for p, n, _ in own if p is not None and n]
            assert len(set(places)) == len(places)
