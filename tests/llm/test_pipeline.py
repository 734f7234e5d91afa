"""The pipeline, stage by stage and whole, against plain Python over its own inputs."""

import sentencepiece

import corpus_pipeline
from residua.llm.classifier import sigmoid
from residua.llm.op6 import model_path
from residua.llm.op9 import learned
from tests.llm import brute


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    net = learned(docs, spark.read.parquet(f"{brute.SF}/labels.parquet"))
    good = [r for r in rows if sigmoid(net.logits([(r[1] or "").encode()]))[0] >= 0.5]
    kept = [(i, t and x, lang, s, t and len(x)) for (i, t, lang, s, _), (_, _, x) in zip(good, brute.lines([r[1] for r in good]), strict=True)]
    stay = {i for i, _, _, k in brute.classes([r[:2] for r in kept], 5, 80) if k}
    single = [r for r in kept if r[0] in stay]
    taken = brute.mix([(r[0], len(brute.words(r[1])), r[3]) for r in single])
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    expected, text = [], {r[0]: r[1] for r in single}
    for i, size, _, _, n in taken:
        ids = sp.encode(text[i] or "", add_eos=True)
        expected += [(i, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(sp.decode(ids)))] * (0 if not n else 2 if n > size else 1)
    x, stages = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        x = corpus_pipeline.written(stage(spark, x, brute.SF), name)
        assert x.columns == docs.columns and x.dtypes == docs.dtypes
        stages.append(sorted(tuple(r) for r in x.collect()))
    assert stages[0] == sorted(good) and stages[1] == sorted(kept) and stages[2] == sorted(single)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, brute.SF).collect())
    assert got == sorted(expected)


def test_empty_documents(spark):
    x = spark.read.parquet(f"{brute.SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        x = stage(spark, x, brute.SF)
        assert x.count() == 0


def test_unusual_rows_and_clashing_columns(spark):
    """Nulls in every column, empty, repeated and very long rows, and columns named like those that operators add."""
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet").limit(60)
    rows = [(*r, 1.5, "k", 7) for r in docs.collect()]
    first = rows[0]
    rows += [first, first, (None, *first[1:]), (None, *first[1:]), (first[0], "another text " * 40, *first[2:])]
    rows += [(900, None, "en", None, None, None, None, None), (901, "", None, "web", 0, None, None, None), (None, None, None, None, None, None, None, None), (902, "  \n\n", "de", "web", 4, 0.0, "", 0), (903, "word " * 60_000 + "x" * 20_000, "en", "web", 320_000, 0.1, "z", 1)]
    schema = f"{brute.DOCS}, score double, `key` string, n_tokens int"
    x = spark.createDataFrame(rows, schema).repartition(3)
    n = len(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, x, brute.SF), name)
        assert out.columns == x.columns and out.dtypes == x.dtypes, name
        got = [tuple(r) for r in out.collect()]
        if name == "line_dedup":
            assert len(got) == n and sum(r[1] is None for r in got) == sum(r["text"] is None for r in x.collect())
        elif name == "mix_sources":
            assert all(r[1] and r[1].split() for r in got) and max(map(got.count, got)) <= 2 * max(map(rows.count, rows))
        else:
            assert len(got) <= n and len({r[1] for r in got if r[1]}) >= 30
        x, n = out, len(got)
    ids = corpus_pipeline.STAGES[-1][1](spark, x, brute.SF)
    assert ids.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and ids.count() == n
