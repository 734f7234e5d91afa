"""The jobs as registered queries: each runs twice into one new folder and returns what stands there then; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.plans.catalog import FORMED
from residua.plans.inputs import new_folder

from .follow_windows import follow_windows, tables
from .turn_contacts import turn_contacts


def _follow_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_folder(spark, "job1")
    for _ in range(2):
        follow_windows(spark, f"{sf_dir}/events.parquet*", f"{at}/output", f"{at}/checkpoint")  # a pattern: a stream takes no single file by its path
    windows, orders = tables(spark, f"{at}/output")
    x = windows.join(orders.select("traj_id", "cluster", "rank"), ["traj_id", "cluster"], "left")
    return x.select("traj_id", "cluster", "widx", "frame", "value", F.coalesce("rank", F.lit(0)).alias("rank"))


def _turn_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_folder(spark, "job2")
    for _ in range(2):
        turn_contacts(spark, f"{sf_dir}/conversations.parquet", f"{at}/output")
    turns, windows, orders = (spark.read.parquet(f"{at}/output/{n}") for n in ("turns", "windows", "orders"))
    x = turns.join(windows.select("conv_id", "turn", "cluster", "widx", "value"), ["conv_id", "turn", "cluster"], "left")
    x = x.join(orders.select("conv_id", "cluster", "rank"), ["conv_id", "cluster"], "left")
    return x.select("conv_id", "turn", "cluster", "n", "size", "smoothed", F.coalesce("widx", F.lit(-1)).alias("widx"), F.coalesce("value", F.lit(-1.0)).alias("value"), F.coalesce("rank", F.lit(0)).alias("rank"))


def queries() -> dict:
    return {"job1_follow_windows": _follow_windows, "job2_turn_contacts": _turn_contacts}


RANKED = "ranked as (select traj_id, cluster, cast(row_number() over (partition by traj_id order by coalesce(e, 0), cluster desc) as int) as rank from keyed where e is not null or f0 = 1)"

FOLLOW = f"""
with raw as (select user_id as traj_id, event_id, cast(coalesce(length(event_type) % 5, 0) as int) as cluster, cast(coalesce(floor(value * 100), 0) as bigint) as n
             from events where user_id is not null and event_id is not null),
pos as (select *, row_number() over (partition by traj_id, cluster order by event_id) - 1 as p from raw),
win as (select traj_id, cluster, cast(p // 10 as bigint) as widx, cast(min(event_id) as int) as frame, cast(sum(n) as double) / (100 * count(*)) as value
        from pos group by traj_id, cluster, cast(p // 10 as bigint) having count(*) = 10),
bin as (select traj_id, widx, cluster, case when value >= cast(62 as double) then 1 else 0 end as f from win where cluster <> 0),
{FORMED}, {RANKED}
select w.traj_id, w.cluster, w.widx, w.frame, w.value, coalesce(r.rank, 0) as rank from win w left join ranked r on r.traj_id = w.traj_id and r.cluster = w.cluster
"""

TURNS = rf"""
with turns as (select conv_id, turn, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w, text
               from conversations where conv_id is not null and turn is not null),
opening as (select conv_id, w, len(w) - 1 as n from (select *, row_number() over (partition by conv_id order by turn, text nulls first) as place from turns) where place = 1),
contacts as (select conv_id, w[k + 1] as a, w[k + 2] as b, cast(1 + (4 * k) // n as int) as cluster from (select *, unnest(range(n)) as k from opening where n > 0)),
words as (select distinct conv_id, turn, unnest(w) as word from turns),
hits as (select c.conv_id, x.turn, c.cluster, count(*) as n from contacts c join words x on x.conv_id = c.conv_id and x.word = c.a join words y on y.conv_id = c.conv_id and y.turn = x.turn and y.word = c.b group by all),
sizes as (select conv_id, cluster, count(*) as size from contacts group by all),
fill as (select f.conv_id as traj_id, cast(f.turn as int) as frame, s.cluster, coalesce(h.n, 0) as n, s.size
         from (select distinct conv_id, turn from turns) f join sizes s on s.conv_id = f.conv_id left join hits h on h.conv_id = f.conv_id and h.turn = f.turn and h.cluster = s.cluster),
pos as (select *, row_number() over (partition by traj_id, cluster order by frame) - 1 as p,
        cast(sum(n) over w as double) / (size * count(*) over w) as smoothed from fill window w as (partition by traj_id, cluster order by frame rows between 1 preceding and 1 following)),
win as (select traj_id, cluster, cast(p // 2 as bigint) as widx, min(frame) as frame, cast(sum(n) as double) / (max(size) * count(*)) as value from pos group by traj_id, cluster, cast(p // 2 as bigint)),
bin as (select traj_id, widx, cluster, case when value >= cast(0.25 as double) then 1 else 0 end as f from win where cluster <> 0),
{FORMED}, {RANKED}
select p.traj_id as conv_id, p.frame as turn, p.cluster, cast(p.n as bigint) as n, p.size, p.smoothed, coalesce(w.widx, -1) as widx, coalesce(w.value, -1) as value, coalesce(r.rank, 0) as rank
from pos p left join win w on w.traj_id = p.traj_id and w.frame = p.frame and w.cluster = p.cluster left join ranked r on r.traj_id = p.traj_id and r.cluster = p.cluster
"""


def oracle_sql() -> dict:
    return {"job1_follow_windows": FOLLOW, "job2_turn_contacts": TURNS}
