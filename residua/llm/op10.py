"""Query op10_warc_archive and its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from . import warc
from .common import shared_dir, table

NAME = "op10_warc_archive"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from an archive of them all."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.index(spark, path)


SQL = r"""
with p as (select page_id, coalesce(html, '') as body from pages),
h as (select page_id, strlen(body) as payload_bytes, sha1(body) as h, min(page_id) over (partition by body) as first from p)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((cast('0x' || substr(h, cast(1 + 5 * (k // 4) as int), 5) as int) >> cast(15 - 5 * (k % 4) as int)) & 31) + 1, 1)), '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from h
"""
