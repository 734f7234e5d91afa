"""Registered queries over the driver's tables and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import binary, list_text, map_text, native_distance, number_text, parse_list, parse_map
from ..operators import formation, graph, ordering, series, views
from ..sources.pdb import read_pdb
from ..sources.tables import read_contacts, read_contacts_raw, read_parsed, read_smoothed, read_summary
from ..streaming.frames import stream_fill
from . import inputs
from .pipeline import analyze

WINDOW, CUTOFF, SMOOTH = 10, 0.62, 100

ATOMS = """
coords as (select cast(vec_id + 1 as int) as frame, cast(k as int) as residue, cast(embedding[3 * k - 2] as double) as x,
                  cast(embedding[3 * k - 1] as double) as y, cast(embedding[3 * k] as double) as z
           from embeddings cross join (select unnest(range(1, 22)) as k) t),
contacts as (select a.residue as i, b.residue as j, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) as r,
                    cast((a.residue + b.residue) % 5 as int) as cluster
             from coords a join coords b on a.frame = 1 and b.frame = 1 and b.residue >= a.residue + 3),
frames as (select distinct frame from coords),
sizes as (select cluster, count(*) as size from contacts group by cluster),
hit as (select ci.frame, c.i, c.j, c.cluster from contacts c join coords ci on ci.residue = c.i join coords cj on cj.residue = c.j and cj.frame = ci.frame
        where sqrt((ci.x-cj.x)*(ci.x-cj.x)+(ci.y-cj.y)*(ci.y-cj.y)+(ci.z-cj.z)*(ci.z-cj.z)) < c.r * cast(1.2 as double)),
hits as (select frame, cluster, count(*) as n from hit group by frame, cluster),
fill as (select f.frame, s.cluster, coalesce(h.n, 0) as n, s.size from frames f cross join sizes s left join hits h on h.frame = f.frame and h.cluster = s.cluster),
q as (select frame, cast(sum(n) as bigint) as contacts, cast(sum(size) as bigint) as total, cast(sum(n) as double) / cast(sum(size) as double) as q from fill group by frame)
"""

EVENTS = """
raw as (select user_id as traj_id, cast(row_number() over (partition by user_id order by ts, event_id) as int) as frame,
               cast(length(event_type) % 5 as int) as cluster, cast(floor(value * 100) as bigint) as n from events),
ep as (select *, row_number() over (partition by traj_id, cluster order by frame) - 1 as p from raw)
"""

WIN = """
pos as (select *, row_number() over (partition by cluster order by frame) - 1 as p from fill),
win as (select cluster, cast(p // 10 as bigint) as widx, min(frame) as frame, cast(sum(n) as double) / (max(size) * count(*)) as value from pos group by cluster, cast(p // 10 as bigint))
"""

#: What leads from ``bin`` (traj_id, widx, cluster, f) to start and order.
FORMED = """
cnt as (select traj_id, widx, sum(f) as c, count(*) as k from bin group by traj_id, widx),
tops as (select *, max(k) over (partition by traj_id) as kk, max(c) over (partition by traj_id) as mx from cnt),
start as (select traj_id, coalesce(min(case when c = kk then widx end), min(case when c = mx and c > 0 then widx end)) as start from tops group by traj_id),
edge as (select traj_id, widx, cluster, f, lag(f) over (partition by traj_id, cluster order by widx) as pf from bin),
keyed as (select e.traj_id, cluster, max(case when f = 1 and pf = 0 and widx <= start then widx end) as e, max(case when widx = 0 then f end) as f0
          from edge e join start s on s.traj_id = e.traj_id group by e.traj_id, cluster)
"""

LATTICE = """
cells as (select cast(l_suppkey % 60 + 1 as int) as i, cast(l_partkey % 60 + 64 as int) as j from lineitem group by all having count(*) >= 21)
"""

PARTS = f"with recursive {LATTICE}, reach as (select i, j, i as ri, j as rj from cells union select c.i, c.j, r.ri, r.rj from reach r join cells c on abs(c.i - r.i) <= 1 and abs(c.j - r.j) <= 1), " \
    "root as (select i, j, min(ri * 1000 + rj) as root from reach group by i, j), numbered as (select i, j, cast(dense_rank() over (order by root) as int) as component from root)"


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formation.evaluated(inputs.frames(spark, sf_dir), inputs.contacts(spark, sf_dir))


def fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formation.fill(evaluated(spark, sf_dir))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formation.frame_results(evaluated(spark, sf_dir))


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice with its components as clusters modulo 12, so that some contacts are unassigned."""
    cells = inputs.lattice(spark, sf_dir)
    return graph.components(cells).withColumn("cluster", (F.col("component") % 12).cast("int"))


CLUSTERED = f"{PARTS}, contacts as (select i, j, cast(component % 12 as int) as cluster from numbered)"


def _native(spark, sf_dir):
    x = inputs.table(spark, sf_dir, "part")
    return x.select("p_partkey", native_distance(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")).alias("r"))


def _pdb(spark, sf_dir):
    x = formation.unpack(read_pdb(spark, inputs.pdb_text(spark, sf_dir)))
    return x.select("frame", "residue", "x", "y", "z")


def _pdb_max(spark, sf_dir):
    x = read_pdb(spark, inputs.pdb_text(spark, sf_dir, files=1), max_frames=10)
    return x.select("frame", F.size("coords").cast("bigint").alias("atoms"))


def _summary(spark, sf_dir, cutoff=None):
    return series.summarize(fill(spark, sf_dir), WINDOW, cutoff)


def _wide(spark, sf_dir):
    return series.wide(_summary(spark, sf_dir), ["widx", "frame"], list(range(inputs.CLUSTERS)))


def _events_summary(spark, sf_dir):
    return series.summarize(inputs.events_fill(spark, sf_dir), WINDOW, CUTOFF * 100)


def _topk(spark, sf_dir):
    sizes = graph.components(inputs.lattice(spark, sf_dir)).groupBy("map_id", "component").agg(F.count("*").alias("size")).filter("size >= 5")
    return graph.top_clusters(sizes, 10).select("component", "size", F.col("place").cast("bigint").alias("place"))


def _edges(spark, sf_dir):
    return graph.adjacency_edges(inputs.lattice(spark, sf_dir)).drop("map_id")


def _wide_parts(spark, sf_dir):
    return graph.components_wide(inputs.lattice(spark, sf_dir)).drop("map_id")


def _roundtrip_map(spark, sf_dir):
    x = results(spark, sf_dir).select("frame", map_text(F.col("clusters_filling")).alias("text"))
    return x.select("frame", "text", F.explode(parse_map(F.col("text"))).alias("cluster", "value"))


def _roundtrip_list(spark, sf_dir):
    x = results(spark, sf_dir).select("frame", list_text(F.col("contact_list")).alias("text"))
    return x.select("frame", F.inline(parse_list(F.col("text"))))


def _csv(df: DataFrame) -> str:
    """``df`` as CSV with header in a new folder; its path."""
    path = inputs.new_folder(df.sparkSession, "csv")
    df.write.option("header", True).option("escape", '"').csv(path)
    return path


def _parsed_csv(spark, sf_dir):
    x = results(spark, sf_dir).select("frame", "contacts", number_text(F.col("q")).alias("q"), list_text(F.col("contact_list")).alias("contact_list"), map_text(F.col("clusters_filling")).alias("clusters_filling"))
    back = read_parsed(spark, _csv(x))
    return back.select("frame", "contacts", "q", F.size("contact_list").alias("listed"), F.explode("clusters_filling").alias("cluster", "value"))


def _summary_csv(spark, sf_dir):
    x = series.wide(_summary(spark, sf_dir, CUTOFF), ["frame"], list(range(inputs.CLUSTERS)))
    return ordering.formation_order(ordering.with_index(read_summary(spark, _csv(x.coalesce(1))))).select("rank", "cluster")


def _smoothed_csv(spark, sf_dir):
    x = series.wide(series.smooth(fill(spark, sf_dir), SMOOTH), ["frame"], list(range(inputs.CLUSTERS)), "_smooth")
    x = x.join(series.smooth_q(formation.frame_q(evaluated(spark, sf_dir)), SMOOTH).select("frame", "q_smooth"), "frame")
    return read_smoothed(spark, _csv(x)).select("frame", "q_smooth", "cluster", "value")


def _contacts_csv(spark, sf_dir):
    x = read_contacts(spark, _csv(inputs.contacts(spark, sf_dir).select("i", "j", number_text(F.col("r")).alias("r"), "cluster")))
    return x.select("i", "j", "r", "cluster")


def _contacts_raw(spark, sf_dir):
    path = inputs.new_folder(spark, "cont")
    inputs.table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_partkey", F.col("p_partkey") + 3, "p_size", F.col("p_retailprice").cast("string"))).write.text(path)
    return read_contacts_raw(spark, path).select("i", "j", "r")


def _stream(spark, sf_dir):
    x = stream_fill(inputs.frames(spark, sf_dir), inputs.contacts(spark, sf_dir).collect())
    return x.select("frame", "contacts", "q", F.inline("clusters"))


def _pipeline(spark, sf_dir):
    a = analyze(inputs.frames(spark, sf_dir), inputs.contacts(spark, sf_dir), smooth_window=SMOOTH, window_size=WINDOW, cutoff=CUTOFF)
    return a.summary.groupBy("cluster").agg(F.count("*").alias("windows"), F.count_if(F.col("value") >= CUTOFF).alias("formed"), F.min("frame").alias("first")).join(a.order.select("cluster", "rank"), "cluster", "left").na.fill(0, "rank")


def _no_id(df: DataFrame) -> DataFrame:
    return df.drop("traj_id", "map_id")


def queries() -> dict:
    return {
        "native_distance": _native,
        "pdb_scan": _pdb,
        "pdb_max_frames": _pdb_max,
        "contact_formed": lambda s, d: evaluated(s, d).filter("formed").select("frame", "i", "j", "cluster"),
        "contact_list": lambda s, d: results(s, d).select("frame", list_text(F.col("contact_list")).alias("contact_list")),
        "frame_q": lambda s, d: formation.frame_q(evaluated(s, d)).select("frame", "contacts", "q"),
        "cluster_sizes": lambda s, d: formation.cluster_sizes(inputs.contacts(s, d)),
        "cluster_filling": lambda s, d: fill(s, d).select("frame", "cluster", "n", "size", (F.col("n") / F.col("size")).alias("filling")),
        "filling_long": lambda s, d: _no_id(formation.filling_long(results(s, d))),
        "smooth_q": lambda s, d: _no_id(series.smooth_q(formation.frame_q(evaluated(s, d)), SMOOTH)),
        "smooth_clusters": lambda s, d: _no_id(series.smooth(fill(s, d), SMOOTH)),
        "smooth_w1": lambda s, d: _no_id(series.smooth(fill(s, d), 1)),
        "smooth_multi": lambda s, d: series.smooth(inputs.events_fill(s, d), SMOOTH),
        "summarize_float": lambda s, d: _no_id(_summary(s, d)),
        "summarize_binary": lambda s, d: _no_id(_summary(s, d, CUTOFF)),
        "summarize_pivot": _wide,
        "summarize_multi": lambda s, d: series.summarize(inputs.events_fill(s, d), WINDOW),
        "summary_shape": lambda s, d: series.summary_shape(_summary(s, d)),
        "binarize": lambda s, d: fill(s, d).select("frame", "cluster", binary(F.col("n") / F.col("size"), 0.5).alias("value")),
        "start_window": lambda s, d: _no_id(ordering.start_window(_summary(s, d, CUTOFF))),
        "formation_order": lambda s, d: _no_id(ordering.formation_order(_summary(s, d, CUTOFF))),
        "formation_order_multi": lambda s, d: ordering.formation_order(_events_summary(s, d), strict=False),
        "formation_text": lambda s, d: ordering.order_text(ordering.formation_order(_events_summary(s, d), strict=False)),
        "adjacency_edges": _edges,
        "components": lambda s, d: _no_id(graph.components(inputs.lattice(s, d))),
        "components_wide": _wide_parts,
        "component_filter_topk": _topk,
        "cluster_contacts": lambda s, d: _no_id(graph.cluster_contacts(inputs.lattice(s, d))),
        "centroids": lambda s, d: _no_id(graph.centroids(clustered(s, d))),
        "contact_map_points": lambda s, d: views.contact_map_points(clustered(s, d)),
        "contact_map_stats": lambda s, d: views.contact_map_stats(clustered(s, d)),
        "cluster_distribution": lambda s, d: views.cluster_distribution(clustered(s, d)),
        "trajectory_series": lambda s, d: _no_id(views.trajectory_series(formation.frame_q(evaluated(s, d)), fill(s, d).withColumn("value", F.col("n") / F.col("size")))).na.fill(-1, "cluster"),
        "read_stats": lambda s, d: formation.read_stats(results(s, d)),
        "animation_points": lambda s, d: _no_id(views.animation_points(results(s, d), inputs.contacts(s, d))),
        "animation_titles": lambda s, d: _no_id(views.animation_titles(results(s, d))),
        "map_literal_roundtrip": _roundtrip_map,
        "contact_list_roundtrip": _roundtrip_list,
        "number_text": lambda s, d: inputs.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", number_text(F.col("l_quantity").cast("double") / F.lit(64.0)).alias("text")),
        "parsed_csv": _parsed_csv,
        "summary_csv": _summary_csv,
        "smoothed_csv": _smoothed_csv,
        "contacts_csv": _contacts_csv,
        "contacts_raw": _contacts_raw,
        "stream_fill": _stream,
        "pipeline_summary": _pipeline,
    }


def oracle_sql() -> dict:
    atoms, win = f"with {ATOMS}", f"with {ATOMS}, {WIN}"
    binned = f"{win}, bin as (select 'embeddings' as traj_id, widx, frame, cluster, case when value >= cast(0.62 as double) then 1 else 0 end as f from win where cluster <> 0), {FORMED}"
    events_win = f"with {EVENTS}, win as (select traj_id, cluster, cast(p // 10 as bigint) as widx, min(frame) as frame, cast(sum(n) as double) / (100 * count(*)) as value from ep group by traj_id, cluster, cast(p // 10 as bigint))"
    events_bin = f"{events_win}, bin as (select traj_id, widx, cluster, case when value >= cast(62 as double) then 1 else 0 end as f from win where cluster <> 0), {FORMED}"
    order = "select traj_id, cast(row_number() over (partition by traj_id order by coalesce(e, 0), cluster desc) as int) as rank, cluster from keyed where e is not null or f0 = 1"
    over = "(partition by cluster order by frame rows between 50 preceding and 50 following)"
    return {
        "native_distance": "select p_partkey, 10 * sqrt(cast(1.2 as double) * (cast(p_retailprice as double) / cast(p_size as double))) as r from part",
        "pdb_scan": f"{atoms} select frame, residue, cast(format('{{:8.3f}}', x) as double) as x, cast(format('{{:8.3f}}', y) as double) as y, cast(format('{{:8.3f}}', z) as double) as z from coords",
        "pdb_max_frames": f"{atoms} select frame, count(*) as atoms from coords where frame <= 10 group by frame",
        "contact_formed": f"{atoms} select frame, i, j, cluster from hit",
        "contact_list": f"{atoms} select f.frame, coalesce('[' || string_agg('(' || i || ', ' || j || ')', ', ' order by i, j) || ']', '[]') as contact_list from frames f left join hit on hit.frame = f.frame group by f.frame",
        "frame_q": f"{atoms} select frame, contacts, q from q",
        "cluster_sizes": f"{atoms} select cluster, size from sizes",
        "cluster_filling": f"{atoms} select frame, cluster, n, size, cast(n as double) / cast(size as double) as filling from fill",
        "filling_long": f"{atoms} select frame, cluster, cast(n as double) / cast(size as double) as value from fill",
        "smooth_q": f"{atoms} select frame, cast(sum(contacts) over w as double) / (total * count(*) over w) as q_smooth from q window w as (order by frame rows between 50 preceding and 50 following)",
        "smooth_clusters": f"{atoms} select frame, cluster, cast(sum(n) over {over} as double) / (size * count(*) over {over}) as value from fill",
        "smooth_w1": f"{atoms} select frame, cluster, cast(n as double) / cast(size as double) as value from fill",
        "smooth_multi": f"with {EVENTS} select traj_id, frame, cluster, cast(sum(n) over w as double) / (100 * count(*) over w) as value from ep window w as (partition by traj_id, cluster order by frame rows between 50 preceding and 50 following)",
        "summarize_float": f"{win} select widx, frame, cluster, value from win",
        "summarize_binary": f"{win} select widx, frame, cluster, case when value >= cast(0.62 as double) then cast(1 as double) else cast(0 as double) end as value from win",
        "summarize_pivot": f"{win} select widx, frame, " + ", ".join(f"coalesce(max(case when cluster = {c} then value end), 0) as cluster_{c}" for c in range(inputs.CLUSTERS)) + " from win group by widx, frame",
        "summarize_multi": f"{events_win} select traj_id, widx, frame, cluster, value from win",
        "summary_shape": f"{win} select count(distinct widx) as windows, count(distinct cluster) as clusters from win",
        "binarize": f"{atoms} select frame, cluster, case when cast(n as double) / cast(size as double) >= 0.5 then cast(1 as double) else cast(0 as double) end as value from fill",
        "start_window": f"{binned} select start from start",
        "formation_order": f"{binned} select rank, cluster from ({order}) t",
        "formation_order_multi": f"{events_bin} {order}",
        "formation_text": f"{events_bin} select traj_id, string_agg(cluster, ',' order by rank) as formation from ({order}) t group by traj_id",
        "adjacency_edges": f"with {LATTICE} select a.i, a.j, b.i as i2, b.j as j2 from cells a join cells b on abs(a.i - b.i) <= 1 and abs(a.j - b.j) <= 1 and (a.i <> b.i or a.j <> b.j)",
        "components": f"{PARTS} select i, j, component from numbered",
        "components_wide": f"{PARTS} select i, j, cast(root // 1000 as int) as root_i, cast(root % 1000 as int) as root_j from root",
        "component_filter_topk": f"{PARTS}, sizes as (select component, count(*) as size from numbered group by component having count(*) >= 5), placed as (select component, size, row_number() over (order by size desc, component) as place from sizes) select * from placed where place <= 10",
        "centroids": f"{CLUSTERED} select cluster, cast(sum(i) as double) / count(*) as centroid_i, cast(sum(j) as double) / count(*) as centroid_j from contacts group by cluster",
        "contact_map_points": f"{CLUSTERED} select j as x, i as y, cluster from contacts where i < j",
        "contact_map_stats": f"{CLUSTERED} select count(*) as total, count(*) filter (where cluster <> 0) as clustered, count(*) filter (where cluster = 0) as unassigned, count(*) filter (where i < j) as below_diagonal, count(distinct case when cluster <> 0 then cluster end) as clusters, max(greatest(i, j)) as max_residue from contacts",
        "cluster_distribution": f"{CLUSTERED} select cluster, count(*) as size from contacts group by cluster",
        "trajectory_series": f"{atoms} select frame, 'q' as panel, cast(-1 as int) as cluster, 'line' as kind, q as value from q union all select frame, 'cluster', cluster, 'line', cast(n as double) / cast(size as double) from fill",
        "read_stats": f"{atoms} select count(*) as frames, min(q) as min_q, max(q) as max_q, cast(sum(contacts) as double) / count(*) as mean_contacts from q",
        "animation_points": f"{atoms} select frame, cluster, greatest(i, j) as x, least(i, j) as y from hit",
        "animation_titles": f"{atoms} select frame, 'Frame ' || frame || ' | Contacts: ' || contacts || ' | Q: ' || format('{{:.3f}}', q) as title from q",
        "contact_list_roundtrip": f"{atoms} select frame, i, j from hit",
        "number_text": "select l_orderkey, l_linenumber, regexp_replace(cast(cast(l_quantity as double) / 64 as varchar), '\\.0$', '') as text from lineitem",
        "map_literal_roundtrip": f"{atoms}, parts as (select frame, cluster, cast(n as double) / cast(size as double) as value from fill), texts as (select frame, '{{' || string_agg(cluster || ': ' || regexp_replace(cast(value as varchar), '\\.0$', ''), ', ' order by cluster) || '}}' as text from parts group by frame) select p.frame, t.text, p.cluster, p.value from parts p join texts t on t.frame = p.frame",
        "parsed_csv": f"{atoms} select f.frame, q.contacts, q.q, cast(q.contacts as int) as listed, f.cluster, cast(f.n as double) / cast(f.size as double) as value from fill f join q on q.frame = f.frame",
        "summary_csv": f"{binned} select rank, cluster from ({order}) t",
        "smoothed_csv": f"{atoms}, qs as (select frame, cast(sum(contacts) over w as double) / (total * count(*) over w) as q_smooth from q window w as (order by frame rows between 50 preceding and 50 following)), fs as (select frame, cluster, cast(sum(n) over {over} as double) / (size * count(*) over {over}) as value from fill) select fs.frame, q_smooth, cluster, value from fs join qs on qs.frame = fs.frame",
        "contacts_csv": f"{atoms} select i, j, r, cluster from contacts",
        "contacts_raw": "select cast(p_partkey as int) as i, cast(p_partkey + 3 as int) as j, 10 * sqrt(cast(1.2 as double) * (cast(p_retailprice as double) / cast(p_size as double))) as r from part",
        "stream_fill": f"{atoms} select f.frame, q.contacts, q.q, f.cluster, f.n, f.size from fill f join q on q.frame = f.frame",
        "pipeline_summary": f"{binned}, ranked as ({order}) select w.cluster, count(*) as windows, count(*) filter (where w.value >= cast(0.62 as double)) as formed, min(w.frame) as first, coalesce(max(r.rank), 0) as rank from win w left join ranked r on r.cluster = w.cluster group by w.cluster",
    }
