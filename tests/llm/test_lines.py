import random

import numpy as np
import pytest

from residua.llm.lines import Shard, dedup_lines
from tests.llm import brute


def test_shard():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 20000):
        a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for _ in "ab")
        s = Shard.build(a, b, np.arange(1, n + 1))
        assert sorted(s.place(a, b).tolist()) == list(range(n)) and s.count(a, b).tolist() == list(range(1, n + 1))
        assert not s.count(rng.integers(0, 2**63, 500, dtype=np.uint64), rng.integers(0, 2**63, 500, dtype=np.uint64)).any()
        assert Shard.of(dict(zip(["shard", "keys", "levels", "bits", "fingerprints", "counts"], s.row(0), strict=True))).count(a, b).tolist() == list(range(1, n + 1))
    with pytest.raises(ValueError):
        Shard.build(np.ones(2, np.uint64), np.ones(2, np.uint64), np.ones(2, np.int64))


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "shard_keys": 2}])
def test_against_brute_force(spark, options):
    rng = random.Random(2)
    pool = ["Common line ", "common LINE", "\tx\x0b", "", " ", "É", "é", "rare"] + [f"line {k}" for k in range(12)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 8))) for _ in range(60)] + [None, "", "\n", "same\nsame\nsame"] + ["a copy\ncommon line"] * 30 + ["long " * 50_000]
    docs = spark.createDataFrame([(k % 80, t, k) for k, t in enumerate(texts)], "doc_id bigint, text string, n_lines int").repartition(3)
    x, names = dedup_lines(docs, **options)
    assert names["n_lines"] != "n_lines"
    got = {r["n_lines"]: (r[names["n_lines"]], r[names["n_dropped"]], r[names["kept_text"]], r[names["kept_sha256"]]) for r in x.collect()}
    for k, (t, (n, d, kept)) in enumerate(zip(texts, brute.lines(texts), strict=True)):
        assert got[k] == (n, d, None if t is None else kept, brute.sha(kept)), k


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": -1}])
def test_empty_tables(spark, options):
    assert dedup_lines(spark.createDataFrame([], "doc_id bigint, text string"), **options)[0].count() == 0
    assert dedup_lines(spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string"), **options)[0].count() == 2


def by_sql(rows, sql):
    import duckdb
    import pandas as pd

    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    return sorted(con.execute(sql).fetchall())


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": -1, "shard_keys": 3}])
def test_counts_decide(spark, monkeypatch, options):
    """Repeated ids count once, as in the query's SQL; the index has all lines of two documents and its counts decide."""
    from residua.llm import lines, op5

    rows = [(k, "\n".join(f"in {m}" for m in (2, 9, 10, 11) if k < m) + f"\nown {k}") for k in range(12)]
    rows += [(3, "in 9\nin 2"), (3, "in 9"), (4, "in 9\nother")]  # still in 9 documents
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    index = lines.build_index(docs, id_col="doc_id")
    counts = sorted(c for r in index.shards.collect() for c in Shard.of(r).counts.tolist())
    assert counts == [2 + 1, 9, 10, 11]
    monkeypatch.setattr(op5, "table", lambda *_: docs)
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"]) for r in op5.query(spark, "", **options).collect())
    total = {}
    for i, n, d in got:
        total[i] = (total.get(i, (0, 0))[0] + n, total.get(i, (0, 0))[1] + d)
    assert {i: v for i, v in total.items()} == {i: (n, d) for i, n, d, _ in by_sql(rows, op5.SQL)}
    none = spark.createDataFrame([(None, "a")] * 10 + [(None, "b")] * 9 + [(1, "b")] * 5, "doc_id bigint, text string")
    x, names = dedup_lines(none, id_col="doc_id", **options)
    assert sorted((r["text"], r[names["n_dropped"]]) for r in x.collect()) == [("a", 1)] * 10 + [("b", 1)] * 14
    x, names = dedup_lines(none, min_docs=1, **options)
    assert {r[names["n_dropped"]] for r in x.collect()} == {1}
