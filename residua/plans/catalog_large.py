"""Registered queries of the ways for large inputs: indexed and ranged files, further formats, large maps; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, formation, graph, series, views
from ..sources.formats import read_frames
from ..sources.pdb import index_pdb, read_pdb
from ..sources.sinks import write_parsed, write_smoothed
from ..sources.tables import read_parsed, read_smoothed
from ..streaming.order import stream_order
from ..streaming.smooth import stream_smooth
from . import catalog, catalog_files, figures, inputs
from .catalog import ATOMS, CUTOFF, EVENTS, SMOOTH, WINDOW
from .catalog_files import ROUNDED


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trajectory from one file, cut into ranges of 5,000 bytes, so that most begin and end within a model."""
    x = formation.unpack(read_pdb(spark, inputs.pdb_text(spark, sf_dir, files=1), wide=5_000))
    return x.select("frame", "residue", "x", "y", "z")


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tenth of the frames by a saved index, with the bytes of their models."""
    at, index = inputs.pdb_text(spark, sf_dir, files=1), inputs.new_folder(spark, "index")
    index_pdb(spark, at, wide=50_000).write.parquet(index)
    most = inputs.table(spark, sf_dir, "embeddings").count() // 10
    x = read_pdb(spark, at, max_frames=most, index=index)
    return x.select("frame", F.size("coords").cast("bigint").alias("atoms"), F.aggregate(F.map_keys("coords"), F.lit(0).cast("bigint"), lambda a, k: a + k).alias("residues"))


def _points(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """The trajectory as a table of points, written and read in another format than PDB, its first hundred frames."""
    path = f"{inputs.new_folder(spark, 'points')}.{source}"
    points = formation.unpack(inputs.frames(spark, sf_dir))
    (points.write.option("header", True).csv(path) if source == "csv" else points.write.parquet(path))
    return formation.unpack(read_frames(spark, path, max_frames=100)).select("traj_id", "frame", "residue", "x", "y", "z")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formed contacts by blocks of five residues, pairs of blocks in chunks of about ten contacts."""
    x = blocks.met(inputs.frames(spark, sf_dir), inputs.contacts(spark, sf_dir), residues=5, chunk=10, salts=3)
    return x.select("frame", "i", "j", "cluster")


def _every_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each contact is formed, of all frames, by blocks."""
    x = formation.evaluated(inputs.frames(spark, sf_dir), inputs.contacts(spark, sf_dir), broadcast_contacts=0)
    return x.groupBy("i", "j").agg(F.count("*").alias("frames"), F.count_if("formed").alias("n"))


def _fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as many series of fractional values."""
    return inputs.events_fill(spark, sf_dir).select("traj_id", "frame", "cluster", (F.col("n") / 100).alias("value"))


def _smoothed_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running means, over 101 rows, that the class writes from its own parsed text, read back."""
    t = catalog_files.trajectory(spark, sf_dir)
    t.smooth(100)
    return read_smoothed(spark, t.file("_100_smoothed.csv")).select("frame", "cluster", F.round("q_smooth", 9).alias("q_smooth"), F.round("value", 9).alias("value"))


def _streamed(rows: DataFrame, parts: list[str], work, keys: list[str]) -> DataFrame:
    """What ``work`` gives of a stream of ``rows`` that is stopped and started anew between its parts: of each key the last batch's rows."""
    spark = rows.sparkSession
    source, sink, state = (inputs.new_folder(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    rows = rows.persist()

    def save(found: DataFrame, batch: int) -> None:
        found.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(sink)

    for part in parts:
        rows.filter(part).write.mode("append").parquet(source)
        x = work(spark.readStream.schema(rows.schema).parquet(source))
        x.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    rows.unpersist()
    found = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in x.schema)}, batch int").parquet(sink)
    last = found.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return found.join(last, [*keys, "batch"])


def _stream_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of formation on a stream of windows."""
    windows = series.summarize(inputs.events_fill(spark, sf_dir), WINDOW, CUTOFF * 100).select("traj_id", "widx", "cluster", "value")
    return _streamed(windows, ["widx = 0", "widx in (1, 2)", "widx > 2"], stream_order, ["traj_id"]).select("traj_id", "rank", "cluster")


def _stream_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running means over 101 rows on a stream of counts."""
    fill = inputs.events_fill(spark, sf_dir)
    return _streamed(fill, ["frame <= 30", "frame > 30 and frame <= 45", "frame > 45"], lambda x: stream_smooth(x, SMOOTH), ["traj_id", "cluster", "frame"]).select("traj_id", "frame", "cluster", "value")


def _parsed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsed table as ordered part files, written by executors, read back."""
    path = inputs.new_folder(spark, "parsed")
    write_parsed(catalog.results(spark, sf_dir), path, parts=True)
    back = read_parsed(spark, path)
    return back.select("frame", "contacts", "q", F.size("contact_list").alias("listed"), F.explode("clusters_filling").alias("cluster", "value"))


def _smoothed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running means over 101 rows as ordered part files, read back."""
    path = inputs.new_folder(spark, "smoothed")
    q, fill = formation.frame_q(catalog.evaluated(spark, sf_dir)), catalog.fill(spark, sf_dir)
    write_smoothed(series.smooth_q(q, SMOOTH), series.smooth(fill, SMOOTH), path, parts=True)
    return read_smoothed(spark, path).select("frame", "q_smooth", "cluster", "value")


def _outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a drawing 20 places wide has of the trajectory's lines."""
    q, c = formation.frame_q(catalog.evaluated(spark, sf_dir)), catalog.fill(spark, sf_dir).withColumn("value", F.col("n") / F.col("size"))
    x = figures.outlined(views.trajectory_series(q, c), points=20)
    return x.select("panel", F.coalesce("cluster", F.lit(-1)).alias("cluster"), "frame", "value")


def queries() -> dict:
    return {
        "line_outline": _outline,
        "parsed_parts": _parsed_parts,
        "smoothed_parts": _smoothed_parts,
        "stream_order": _stream_order,
        "stream_smooth": _stream_smooth,
        "smooth_fractions": lambda s, d: series.smooth_values(_fractions(s, d), 7),
        "summarize_fractions": lambda s, d: series.summarize_values(_fractions(s, d), 7),
        "smoothed_file": _smoothed_file,
        "formed_blocks": _blocks,
        "evaluated_blocks": _every_contact,
        "cluster_split_joins": lambda s, d: graph.cluster_contacts(catalog_files._lines_map(s, d), 3, 4, most=0).select("map_id", "i", "j", "cluster"),
        "pdb_ranges": _ranges,
        "pdb_indexed": _indexed,
        "points_parquet": lambda s, d: _points(s, d, "parquet"),
        "points_csv": lambda s, d: _points(s, d, "csv"),
    }


def oracle_sql() -> dict:
    first = f"with {ATOMS} select 'embeddings' as traj_id, frame, residue, x, y, z from coords where frame <= 100"
    over = "(partition by cluster order by frame rows between 50 preceding and 50 following)"
    lines = "s as (select 'q' as panel, cast(-1 as int) as cluster, frame, q as value from q union all select 'cluster', cluster, frame, cast(n as double) / cast(size as double) from fill)"
    places = "k as (select *, (frame - (select min(frame) from s)) // ((select (max(frame) - min(frame)) // 20 + 1 from s)) as k from s)"
    ranks = ", ".join(f"row_number() over (partition by panel, cluster, k order by {o}) as r{n}" for n, o in enumerate(("frame", "frame desc", "value, frame", "value desc, frame desc")))
    return {
        "line_outline": f"with {ATOMS}, {lines}, {places}, r as (select *, {ranks} from k) select panel, cluster, frame, value from r where r0 = 1 or r1 = 1 or r2 = 1 or r3 = 1",
        "parsed_parts": catalog.oracle_sql()["parsed_csv"],
        "smoothed_parts": catalog.oracle_sql()["smoothed_csv"],
        "stream_smooth": catalog.oracle_sql()["smooth_multi"],
        "stream_order": catalog.oracle_sql()["formation_order_multi"],
        "smooth_fractions": f"with {EVENTS} select traj_id, frame, cluster, cast(sum(n) over w as double) / 100 / count(*) over w as value from ep window w as (partition by traj_id, cluster order by frame rows between 3 preceding and 3 following)",
        "summarize_fractions": f"with {EVENTS} select traj_id, cast(p // 7 as bigint) as widx, min(frame) as frame, cluster, cast(sum(n) as double) / 100 / count(*) as value from ep group by traj_id, cluster, cast(p // 7 as bigint)",
        "smoothed_file": f"with {ROUNDED}, qs as (select frame, round(cast(sum(contacts) over w as double) / (total * count(*) over w), 9) as q_smooth from q window w as (order by frame rows between 50 preceding and 50 following)), "
                         f"fs as (select frame, cluster, round(cast(sum(n) over {over} as double) / (size * count(*) over {over}), 9) as value from fill) select fs.frame, cluster, q_smooth, value from fs join qs on qs.frame = fs.frame",
        "formed_blocks": f"with {ATOMS} select frame, i, j, cluster from hit",
        "evaluated_blocks": f"with {ATOMS}, n as (select i, j, count(*) as n from hit group by i, j) select c.i, c.j, (select count(*) from frames) as frames, coalesce(n.n, 0) as n from contacts c left join n on n.i = c.i and n.j = c.j",
        "cluster_split_joins": catalog_files.oracle_sql()["cluster_split"],
        "pdb_ranges": f"with {ROUNDED} select frame, residue, x, y, z from near",
        "pdb_indexed": f"with {ATOMS} select frame, count(*) as atoms, cast(sum(residue) as bigint) as residues from coords where frame <= (select count(*) // 10 from embeddings) group by frame",
        "points_parquet": first,
        "points_csv": first,
    }
