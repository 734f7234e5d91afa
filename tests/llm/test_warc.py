import base64
import hashlib
import shutil

import pytest

from residua.llm import warc

PAGES = [(5, "u5", "same"), (3, "u3", "same"), (9, "u9", "é" * 50_000), (7, "u7\r\nX: y", None), (8, "u8", ""), (4, None, "once"), (None, "n", "same"), (3, "u3", "same"), (6, "u6", "twice"), (6, "u6", "twice")]


def archive(spark, path, pages=PAGES, **options):
    warc.write(spark.createDataFrame(pages, "page_id bigint, url string, html string"), str(path), **options)
    return str(path)


def test_index(spark, tmp_path):
    got = sorted(((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.index(spark, archive(spark, tmp_path / "a")).collect()), key=str)
    data = lambda h: (h or "").encode()
    digest = lambda h: base64.b32encode(hashlib.sha1(data(h)).digest()).decode()
    first, expected = {}, []
    for i, u, h in sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0)):
        d = digest(h)
        expected.append((i or -1, len(data(h)), d, "revisit" if d in first else "response", first.get(d)))
        first.setdefault(d, i)
    assert got == sorted(expected, key=str)


def test_records_and_single_payloads(spark, tmp_path):
    path = archive(spark, tmp_path / "a")
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for *_, h in PAGES})
    whole = [bytes(r["record"]) for r in warc.records(spark, path).collect()]
    assert len(whole) == len(PAGES)
    for r in whole:
        head, _, block = r.partition(b"\r\n\r\n")
        fields = warc.parse(r)
        body = block[: int(fields["content-length"])]
        assert block[len(body) :] == b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")
        payload = body.partition(b"\r\n\r\n")[2]
        assert len(payload) == (int(fields["payload-length"]) if fields["warc-type"] == "response" else 0)
        if payload or fields["payload-length"] == "0":
            assert "sha1:" + warc.digest32(payload) == fields["warc-payload-digest"]
    ids = [warc.parse(r)["warc-record-id"] for r in whole]
    assert len(set(ids)) == len(ids)
    assert {warc.parse(r)["warc-refers-to"] for r in whole if b"WARC-Type: revisit" in r} <= set(ids)


def test_small_payloads_and_empty_tables(spark, tmp_path):
    assert {r["record_type"] for r in warc.index(spark, archive(spark, tmp_path / "a", min_bytes=10)).filter("payload_bytes < 10").collect()} == {"response"}
    assert warc.index(spark, archive(spark, tmp_path / "b", [])).count() == 0


def test_damage_is_found(spark, tmp_path):
    path = archive(spark, tmp_path / "a")
    bad = spark.read.parquet(f"{path}/payloads").selectExpr("sha256", "cast(concat(cast(payload as string), '!') as binary) as payload")
    bad.write.parquet(f"{path}/bad")
    shutil.rmtree(f"{path}/payloads")
    shutil.move(f"{path}/bad", f"{path}/payloads")
    with pytest.raises(Exception, match="damaged"):
        warc.index(spark, path).collect()


def test_both_ways_of_writing(spark, tmp_path, monkeypatch):
    rows = sorted(map(str, warc.index(spark, archive(spark, tmp_path / "a")).collect()))
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    path = archive(spark, tmp_path / "b")
    assert sorted(map(str, warc.index(spark, path).collect())) == rows
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for *_, h in PAGES})


def test_hot_payloads_and_clashing_columns(spark, tmp_path):
    """A short payload that most responses have, and columns named like the archive's own."""
    pages = [(k, f"u{k}", "hot" if k % 3 else f"page {k}", "x", "y", "z") for k in range(1800)]
    docs = spark.createDataFrame(pages, "page_id bigint, url string, html string, sha256 string, `key` string, payload string")
    warc.write(docs, str(tmp_path / "a"), min_bytes=5)
    got = {r["page_id"]: r for r in warc.index(spark, str(tmp_path / "a")).collect()}
    assert len(got) == 1800 and {r["record_type"] for r in got.values()} == {"response"}
    assert all(r["payload_digest"] == warc.digest32(h.encode()) and r["payload_bytes"] == len(h) for k, _, h, *_ in pages for r in [got[k]])
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 601
    whole = {warc.parse(r["record"])["x-page-id"]: bytes(r["record"]) for r in warc.records(spark, str(tmp_path / "a")).collect()}
    assert len(whole) == 1800 and all(whole[str(k)].endswith(b"\r\n\r\n" + h.encode() + b"\r\n\r\n") for k, _, h, *_ in pages)


def test_missing_payloads_raise(spark, tmp_path):
    path = archive(spark, tmp_path / "a")
    shutil.move(f"{path}/payloads", f"{path}/old")
    spark.read.parquet(f"{path}/old").limit(0).write.parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="no payload"):
        warc.index(spark, path).collect()
