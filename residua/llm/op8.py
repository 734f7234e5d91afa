"""Query op8_mix_curriculum and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .mixing import curriculum

NAME = "op8_mix_curriculum"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, position (first pass; null if not taken), in training order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    x, _ = curriculum(docs)
    x = x.select("doc_id", "size", "source_size", "target", "taken", F.element_at("position", 1).alias("position"))
    return x.orderBy(F.col("position").asc_nulls_last(), "doc_id")


SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
                  md5(coalesce(cast(doc_id as varchar), '')) as k from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, row_number() over (order by source nulls last) - 1 as n from s),
v as (select *, case n % 3 when 0 then 5 when 1 then 2 else 1 end as weight,
             cast(case n % 3 when 0 then -0.5 when 1 then 0 else 0.5 end as double) as a, 2 * source_size as cap from w),
c as (select *, coalesce(sum(cap) over (order by cast(cap as double) / weight, n rows between unbounded preceding and 1 preceding), 0) as cb,
             coalesce(sum(weight) over (order by cast(cap as double) / weight, n rows between unbounded preceding and 1 preceding), 0) as wb,
             sum(source_size) over () as total, sum(weight) over () as ws from v),
e as (select *, cast(cap * (ws - wb) as double) <= (cast(1.5 as double) * cast(total as double) - cast(cb as double)) * weight as capped from c),
f as (select *, sum(case when capped then cap else 0 end) over () as cs, sum(case when capped then weight else 0 end) over () as wc from e),
t as (select source, source_size, a, case when capped then cast(cap as double)
        else cast(weight as double) * (cast(1.5 as double) * cast(total as double) - cast(cs as double)) / cast(ws - wc as double) end as target from f),
r as (select d.doc_id, d.size, t.source_size, t.target, t.a,
             cast(coalesce(sum(d.size) over (partition by d.source order by d.k, d.size rows between unbounded preceding and 1 preceding), 0) as bigint) as start
      from d join t on d.source is not distinct from t.source),
g as (select *, greatest(0, least(size, cast(floor(target) as bigint) - start)) as g0,
             greatest(0, least(size, cast(floor(target) as bigint) - source_size - start)) as g1,
             least(cast(1 as double), cast(start as double) / nullif(target, 0)) as u from r)
select doc_id, size, source_size, target, cast(g0 + g1 as bigint) as taken,
       case when g0 > 0 then 2 * u / ((1 - a) + sqrt((1 - a) * (1 - a) + 4 * a * u)) end as position
from g
"""
