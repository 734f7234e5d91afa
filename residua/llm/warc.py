"""A content-addressed WARC archive: payload bytes once by digest, exact record headers apart, records by join.

``write`` makes two tables in a folder.  ``payloads``: sha256, payload, one row per different payload.  ``headers``: the
exact bytes that precede each record's payload and the sha256 of that payload.  Equal payloads are found by SHA-256,
which is verified on reading; the WARC header carries the customary SHA-1 in base32.

Writing sends no payload through a shuffle as long as repeated payloads are few enough for a broadcast of their digests;
``records`` joins each response's header with its payload, and ``index`` reads the records that come out of it.
"""

from __future__ import annotations

import base64
import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, col, join_hot, written
from .texts import append, encode

HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Digests of repeated payloads, with their first record's key, that are broadcast at most: 130 bytes each.
BROADCAST_DIGESTS = 200_000


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: str) -> str:
    return f"<urn:uuid:{key[:8]}-{key[8:12]}-{key[12:16]}-{key[16:20]}-{key[20:32]}>"


def header_of(page, url, key: str, sha1: str, size: int, kind: str, first, first_url, first_key) -> bytes:
    """The WARC header and the HTTP head of a record; the payload follows in a response."""
    http = HTTP.format(size)
    one_line = lambda u: re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", u or "")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {one_line(url)}", f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(http) + (size if kind == 'response' else 0)}"]
    lines += [] if page is None else [f"X-Page-ID: {page}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first_key)}", f"WARC-Refers-To-Target-URI: {one_line(first_url)}", f"WARC-Refers-To-Date: {DATE}"]
        lines += [] if first is None else [f"X-Refers-To-Page-ID: {first}"]
    return encode("\r\n".join(lines) + "\r\n\r\n" + http)


def parse(header: bytes) -> dict[str, str]:
    """Named fields of a record's WARC header; names in lower case, with ``payload-length`` from its HTTP head."""
    warc, _, http = header.partition(b"\r\n\r\n")
    fields = dict(re.findall(r"(?m)^([\w-]+): ([^\r\n]*)", warc.decode("utf-8", "surrogatepass")))
    out = {k.lower(): v for k, v in fields.items()}
    out["payload-length"] = re.search(rb"Content-Length: (\d+)", http)[1].decode()
    return out


def _digests(pages: DataFrame, id_col: str, url_col: str, body_col: str, keep_body: bool) -> DataFrame:
    def work(ids: list, urls: list, bodies: list) -> list[list]:
        out = []
        for i, u, b in zip(ids, urls, bodies, strict=True):
            data = encode(b)
            sha = hashlib.sha256(data).hexdigest()
            out.append((sha, digest32(data), len(data), hashlib.sha256(repr((i, u, sha)).encode("utf-8", "surrogatepass")).hexdigest(), *((data,) if keep_body else ())))
        return [list(c) for c in zip(*out, strict=True)]

    x = pages.select(col(id_col).alias("page"), col(url_col).alias("url"), col(body_col).alias("body"))
    fields = [("sha256", "string"), ("sha1", "string"), ("size", "bigint"), ("key", "string"), *([("payload", "binary")] if keep_body else [])]
    return append(x, ["page", "url", "body"], work, fields, drop=("body",))


def write(pages: DataFrame, path: str, id_col="page_id", url_col="url", body_col="html", min_bytes: int = 0) -> None:
    """Archive every row of ``pages`` in the new folder ``path``.

    Of records with equal payloads of at least ``min_bytes`` bytes that with the smallest id (null last, then url) is a
    response and the others are revisits of it; smaller payloads are always responses.  A null body is an empty payload.
    Rows equal in id, url and body are records of their own, of which one can be the response.
    """
    spark = pages.sparkSession
    small = f"{path}/digests"
    _digests(pages, id_col, url_col, body_col, False).groupBy("page", "url", "sha256", "sha1", "size", "key").agg(F.count("*").alias("copies")).write.option("compression", "zstd").parquet(small)
    rows = spark.read.parquet(small)  # a row's weight in first counts different rows; equal ones are copies
    order = F.struct(F.col("page").isNull().alias("n"), "page", F.col("url").isNull().alias("m"), "url", "key")
    first = rows.groupBy("sha256").agg(F.min(order).alias("f"), F.count("*").alias("weight")).select(
        "sha256", "weight", F.col("f.page").alias("first"), F.col("f.url").alias("first_url"), F.col("f.key").alias("first_key"))
    records = join_hot(rows, first, "sha256", "weight").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    kind = F.when((F.col("size") < min_bytes) | ((F.col("key") == F.col("first_key")) & (F.col("copy") == 1)), "response").otherwise("revisit")
    records = records.withColumn("kind", kind)

    def heads(*columns: list) -> list[list]:
        out = []
        for page, url, key, copy, sha1, size, kind, first, first_url, first_key in zip(*columns, strict=True):
            own = key if copy == 1 else hashlib.sha256(f"{key}{copy}".encode()).hexdigest()
            out.append((record_id(own), header_of(page, url, own, sha1, size, kind, first, first_url, first_key)))
        return [list(c) for c in zip(*out, strict=True)]

    columns = ["page", "url", "key", "copy", "sha1", "size", "kind", "first", "first_url", "first_key"]
    out = append(records.select(*columns, "sha256"), columns, heads, [("record_id", "string"), ("header", "binary")])
    out.select("record_id", "header", "sha256").write.option("compression", "zstd").parquet(f"{path}/headers")
    bodies = _digests(pages, id_col, url_col, body_col, True).select("key", "sha256", "payload")
    repeated = first.filter("weight > 1").select("sha256", "first_key")
    if repeated.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:  # each row finds by itself whether it is its payload's first
        bodies = bodies.join(F.broadcast(repeated), "sha256", "left").filter("first_key is null or first_key = key")
    else:
        bodies = bodies.join(first.select(F.col("first_key").alias("key")), "key", "left_semi")
    if rows.filter("copies > 1").take(1):
        bodies = bodies.dropDuplicates(["key"])
    bodies.select("sha256", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """record_id, sha256, full, record: the bytes of every record; a response without its payload raises.

    Payloads that over 1/HOT_SHARE of the responses share (there are fewer than HOT_SHARE, all of them short) are broadcast.
    """
    heads = spark.read.parquet(f"{path}/headers").withColumn("full", F.expr("decode(header, 'UTF-8')").contains("\r\nWARC-Type: response\r\n"))
    payloads = spark.read.parquet(f"{path}/payloads")
    end = F.encode(F.lit("\r\n\r\n"), "UTF-8")
    responses = heads.filter("full")
    hot = [r["sha256"] for r in responses.groupBy("sha256").count().filter(F.col("count") > max(1000, heads.count() // HOT_SHARE)).collect()]
    is_hot = F.col("sha256").isin(hot) if hot else F.lit(False)
    both = responses.filter(~is_hot).join(payloads, "sha256", "left")
    if hot:
        both = both.unionByName(responses.filter(is_hot).join(F.broadcast(payloads.filter(is_hot)), "sha256", "left"))
    payload = F.coalesce("payload", F.raise_error(F.concat(F.lit("no payload "), F.col("sha256"))).cast("binary"))
    names = ["record_id", "sha256", "full"]
    return both.select(*names, F.concat("header", payload, end).alias("record")).unionByName(heads.filter("not full").select(*names, F.concat("header", end).alias("record")))


def records(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record: the bytes of every WARC record, reconstructed by joining headers with payloads; revisits have none."""
    return _whole(spark, path).select("record_id", "record")


def index(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, read from the reconstructed records.

    A response's size and digests are those of the payload that its record has; a revisit's are those of the response
    with its payload.  A payload that isn't what its name, the SHA-256, or a header says raises.
    """

    def work(names: list, wholes: list) -> list[list]:
        out = []
        for name, record in zip(names, wholes, strict=True):
            f = parse(record)
            said, length, size, sha1 = f["warc-payload-digest"].removeprefix("sha1:"), int(f["payload-length"]), None, None
            if f["warc-type"] == "response":
                payload = bytes(record).split(b"\r\n\r\n", 2)[2][: -len(b"\r\n\r\n")]
                size, sha1 = len(payload), digest32(payload)
                if hashlib.sha256(payload).hexdigest() != name or (sha1, size) != (said, length):
                    raise ValueError(f"payload {name} is damaged")
            out.append((f.get("x-page-id"), f["warc-type"], f.get("x-refers-to-page-id"), said, length, sha1, size))
        return [list(c) for c in zip(*out, strict=True)]

    fields = [("page", "string"), ("record_type", "string"), ("refers", "string"), ("said", "string"), ("length", "bigint"), ("sha1", "string"), ("size", "bigint")]
    x = written(append(_whole(spark, path).select("sha256", "full", "record"), ["sha256", "record"], work, fields, drop=("record",)), "records")
    own = lambda d, size, digest: d.select(F.col("page").cast(id_type).alias("page_id"), F.col(size).alias("payload_bytes"), digest.alias("payload_digest"), "record_type", F.col("refers").cast(id_type).alias("refers_to"))
    responses, revisits = x.filter("full"), x.filter("not full").drop("sha1", "size")
    counts = revisits.groupBy("sha256").agg(F.count("*").alias("weight"))
    found = counts.join(responses.select("sha256", "sha1", "size").dropDuplicates(["sha256"]), "sha256", "left")
    revisits = join_hot(revisits, found, "sha256", "weight")
    agree = F.coalesce((F.col("said") == F.col("sha1")) & (F.col("length") == F.col("size")), F.lit(False))
    digest = F.when(agree, F.col("sha1")).otherwise(F.raise_error(F.concat(F.lit("no payload as a header says: "), F.col("sha256"))))
    return own(responses, "size", F.col("sha1")).unionByName(own(revisits, "size", digest))
