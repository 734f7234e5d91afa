"""Query op2_minhash_dedup and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .neardups import near_duplicates

NAME = "op2_minhash_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document: 3-word shingles, similarity 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
        else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as u, b.doc_id as v, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select u, v from p join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 85 * (x.n + y.n - c)),
b as (select u, v from e union all select v, u from e),
r as (select doc_id as node, doc_id as root from w union select b.v, r.root from r join b on b.u = r.node where r.root < b.v)
select w.doc_id, coalesce(max(n.n), 0) as n_shingles, min(r.root) as component_id, w.doc_id = min(r.root) as kept
from w left join n on n.doc_id = w.doc_id join r on r.node = w.doc_id group by w.doc_id
"""
