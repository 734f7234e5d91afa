"""Trajectories and contact maps of files, for callers who want results on disk or in hand.

Everything is computed by the operators on DataFrames; this module names files, writes them and draws.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions.columns import kept
from .operators import formation, graph, ordering, series, views
from .plans import figures
from .plans.pipeline import Analysis, analyze
from .sources import sinks
from .sources.formats import read_frames
from .sources.tables import read_contacts, read_contacts_raw, read_parsed, read_smoothed, read_summary, require_columns


def _there(path: str) -> str:
    """The path as Spark, which may run in another folder, finds it."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return os.path.abspath(path)


def _not_empty(df: DataFrame, what: str) -> DataFrame:
    if not df.take(1):
        raise ValueError(f"{what} has no rows")
    return df


#: The columns of a parsed table that series are made of.
NUMBERS = ("traj_id", "frame", "q", "clusters_filling")


def _smoothed(own: DataFrame, window_size: int) -> tuple[DataFrame, DataFrame]:
    """Running means of q and of the clusters."""
    q = series.smooth_values(own.select("traj_id", "frame", F.col("q").alias("q_smooth")), window_size, "q_smooth", ("traj_id",))
    return q, series.smooth_values(formation.filling_long(own), window_size)


def _named(own: DataFrame) -> list[int]:
    """The clusters that a parsed table names: those of its series."""
    return sinks.clusters_of(own.select(F.explode(F.map_keys("clusters_filling")).alias("cluster")))


class Trajectory:
    """One trajectory, a PDB file or another of the registered formats, with its clustered contacts."""

    def __init__(self, spark: SparkSession, path: str, contacts: str, directory: str | None = None, format: str = "pdb"):
        self.spark, self.path, self.format = spark, os.path.abspath(path), format
        self.directory = os.path.abspath(directory or os.path.dirname(path))
        self.contacts = read_contacts(spark, _there(contacts))
        require_columns(self.contacts, ("i", "j", "r", "cluster"))

    def file(self, suffix: str) -> str:
        return sinks.output_path(self.path, suffix, self.directory)

    def frames(self, max_frames: int | None = None) -> DataFrame:
        return read_frames(self.spark, _there(self.path), self.format, max_frames)

    def read_trajectory(self, cutoff_distance: float = 1.2, max_frames: int | None = None, write: bool = True, output: str | None = None) -> DataFrame:
        """The parsed table; also as {stem}_parsed.csv or ``output``, with its header alone if there are no frames."""
        out = formation.analyzed(self.frames(max_frames), self.contacts, cutoff_distance)[0]
        if write:
            sinks.write_parsed(out, output or self.file("_parsed.csv"))
        return out

    def parsed(self, cutoff_distance: float = 1.2, max_frames: int | None = None, csv: str | None = None) -> DataFrame:
        """A parsed CSV: the given one, that of an earlier read, or of a new one."""
        path = csv or self.file("_parsed.csv")
        if not csv and not os.path.exists(path):
            self.read_trajectory(cutoff_distance, max_frames)
        return read_parsed(self.spark, _there(path))

    def smooth(self, window_size: int = 100, csv: str | None = None) -> DataFrame:
        """traj_id, frame, cluster, value; also {stem}_{w}_smoothed.csv with q."""
        with kept(self.parsed(csv=csv).select(*NUMBERS)) as own:
            q, out = _smoothed(_not_empty(own, "the parsed trajectory"), window_size)
            sinks.write_smoothed(q, out, self.file(f"_{window_size}_smoothed.csv"), clusters=_named(own))
        return out

    def summarize_trajectory(self, window_size: int = 10_000, cutoff: float | None = None, csv: str | None = None, output: str | None = None) -> DataFrame:
        """traj_id, widx, frame, cluster, value; also {stem}_summary.csv or {stem}_summary_binary_{cutoff}.csv."""
        with kept(self.parsed(csv=csv).select(*NUMBERS)) as own:
            out = series.summarize_values(formation.filling_long(_not_empty(own, "the parsed trajectory")), window_size, cutoff)
            sinks.write_summary(out, output or self.file("_summary.csv" if cutoff is None else f"_summary_binary_{cutoff}.csv"), clusters=_named(own))
        return out

    def classify(self, summary: str | DataFrame | None = None, cutoff: float = 0.5, output: str | None = None) -> list[int]:
        """Clusters in order of formation, first formed first; also {stem}_class.txt."""
        if summary is None:
            summary = self.file(f"_summary_binary_{cutoff}.csv")
        x = read_summary(self.spark, _there(summary)) if isinstance(summary, str) else summary
        _not_empty(x.filter("cluster <> 0"), "the summary")
        x = x if "widx" in x.columns else ordering.with_index(x)
        found = [r["cluster"] for r in ordering.formation_order(x).orderBy("rank").collect()]
        sinks.write_order(found, output or self.file("_class.txt"))
        return found

    def draw(self, window_size: int = 100, csv: str | None = None, raw_values: bool = False, output_format: str = "svg") -> tuple[DataFrame, str]:
        """The series of both panels, and the SVG or PNG they are drawn to."""
        with kept(self.parsed(csv=csv).select(*NUMBERS)) as own:
            raw = formation.filling_long(_not_empty(own, "the parsed trajectory"))
            if window_size > 1:
                self.smooth(window_size, csv)
                s = read_smoothed(self.spark, self.file(f"_{window_size}_smoothed.csv"))
                lines = views.trajectory_series(s.select("traj_id", "frame", "q_smooth").distinct(), views.of_contacts(s, self.contacts), own if raw_values else None, raw if raw_values else None)
            else:
                lines = views.trajectory_series(own, raw)
            return lines, figures.lines(lines, self.file(f"_trajectory.{output_format}"), "Native contact formation")

    def plot_summary(self, summary: str | None = None, cutoff: float | None = None, output_format: str = "svg") -> tuple[DataFrame, str]:
        """The lines of a summary CSV, the given one or the trajectory's own, with a cutoff as 0 and 1, and the SVG or PNG they are drawn to."""
        name = "_summary" if cutoff is None else f"_summary_binary_{cutoff}"
        lines = views.summary_series(_not_empty(read_summary(self.spark, _there(summary or self.file(f"{name}.csv"))), "the summary"), cutoff)
        return lines, figures.lines(lines, self.file(f"{name}.{output_format}"), "Cluster formation", (-0.1, 1.1) if cutoff is not None else None)

    def summary_counts(self, summary: str | None = None, cutoff: float = 0.5) -> DataFrame:
        """cluster, windows, formed of a summary CSV: in how many windows each cluster reaches the cutoff."""
        return series.summary_counts(read_summary(self.spark, _there(summary or self.file("_summary.csv"))), cutoff)

    def animate(self, csv: str | None = None, output_format: str = "gif", interval: int = 50, fps: int = 20) -> tuple[DataFrame, DataFrame, str]:
        """Points and titles of every frame, and the GIF or MP4 they are drawn to; an MP4 holds PNG images, since no video encoder is part of this package."""
        if output_format not in ("gif", "mp4"):
            raise ValueError(f"unknown format {output_format}")
        own = _not_empty(self.parsed(csv=csv), "the parsed trajectory")
        points, titles = views.animation_points(own, self.contacts), views.animation_titles(own)
        size = self.contacts.agg(F.max(F.greatest("i", "j"))).first()[0] or 100
        path, frames = self.file(f"_animation.{output_format}"), own.select("frame")
        return points, titles, figures.animation(points, frames, size, path, interval) if output_format == "gif" else figures.movie(points, frames, size, path, fps)

    def parse(self, cutoff_distance: float = 1.2, max_frames: int | None = None, window_size: int = 10_000, cutoff: float = 0.5, animate: bool = False, output_format: str = "svg") -> list[int]:
        """All steps: parsed table, running means, float and binary summaries, drawings, formation order, animation on demand."""
        self.read_trajectory(cutoff_distance, max_frames)
        self.draw(output_format=output_format)
        self.summarize_trajectory(window_size)
        self.plot_summary(output_format=output_format)
        self.summarize_trajectory(window_size, cutoff)
        self.plot_summary(cutoff=cutoff, output_format=output_format)
        order = self.classify(cutoff=cutoff)
        if animate:
            self.animate()
        return order

    def analysis(self, **options) -> Analysis:
        """The same as one graph of DataFrames, without text files between the steps."""
        return analyze(self.frames(options.pop("max_frames", None)), self.contacts, **options)

    def stats(self, results: DataFrame) -> dict:
        return formation.read_stats(results).first().asDict()


class ContactMap:
    """A raw contact list, clustered."""

    def __init__(self, spark: SparkSession, path: str, clusters: int = 10, cutoff_size: int = 5, halve: bool = True):
        self.spark, self.path = spark, path
        self.contacts = graph.cluster_contacts(read_contacts_raw(spark, _there(path)), clusters, cutoff_size, halve=halve).persist()

    @classmethod
    def of_csv(cls, spark: SparkSession, path: str) -> ContactMap:
        """An already clustered list; nothing is written."""
        out = cls.__new__(cls)
        out.spark, out.path, out.contacts = spark, path, read_contacts(spark, _there(path))
        return out

    def __len__(self) -> int:
        return self.contacts.count()

    def __repr__(self) -> str:
        return f"ContactMap({self.path!r}, contacts={len(self)})"

    def stats(self) -> dict:
        return views.contact_map_stats(self.contacts).first().asDict()

    def save(self, name: str | None = None, directory: str = "results") -> str:
        """{directory}/{name}.csv; the name tells the number of different cluster labels, 0 among them."""
        n = self.contacts.select("cluster").distinct().count()
        path = os.path.join(directory, f"{name or f'contacts_{n}_clusters'}.csv")
        sinks.write_contacts(self.contacts, path)
        return path

    def draw(self, name: str | None = None, directory: str = "results/plots", output_format: str = "svg") -> tuple[DataFrame, str]:
        """The squares below the diagonal, and the SVG or PNG they are drawn to."""
        if "cluster" not in self.contacts.columns:
            raise ValueError("contacts have no clusters")
        _not_empty(self.contacts, "the contact list")
        points = views.contact_map_points(self.contacts)
        stem = name or f"{os.path.splitext(os.path.basename(self.path))[0]}_contact_map"
        return points, figures.contact_map(points, self.stats(), os.path.join(directory, f"{stem}.{output_format}"))


class Rows(Sequence):
    """One dict per frame, by frame: a sequence whose rows come from the executors one after the other, so that a long trajectory needn't be in hand.

    ``list`` of it has all of them; ``frame`` has them as a DataFrame.  Each look computes the rows anew from the files
    they are made of, so these have to stay as they are.
    """

    def __init__(self, frame: DataFrame):
        self.frame = frame

    @staticmethod
    def _dict(r: Row) -> dict:
        plain = lambda v: dict(sorted(v.items())) if isinstance(v, dict) else [tuple(p) for p in v] if isinstance(v, list) else v
        return {k: plain(v) for k, v in r.asDict().items()}

    def __iter__(self) -> Iterator[dict]:
        return map(self._dict, self.frame.orderBy("frame").toLocalIterator())

    def __len__(self) -> int:
        return self.frame.count()

    def __getitem__(self, k: int | slice) -> dict | list[dict]:
        if isinstance(k, slice):
            return list(self)[k]
        found = (self.frame.orderBy("frame") if k >= 0 else self.frame.orderBy(F.desc("frame"))).offset(k if k >= 0 else -k - 1).limit(1).collect()
        if not found:
            raise IndexError(k)
        return self._dict(found[0])

    def __eq__(self, other: object) -> bool:
        return list(self) == list(other) if isinstance(other, Sequence) else NotImplemented


def _rows(df: DataFrame, key: str, suffix: str, extra: tuple[str, ...] = ()) -> Rows:
    """One row per frame, with the clusters' values by column name."""
    name = F.concat(F.lit("cluster_"), F.col("cluster").cast("string"), F.lit(suffix))
    x = df.groupBy("frame", *extra).agg(F.map_from_entries(F.collect_list(F.struct(name.alias("name"), "value"))).alias(key))
    return Rows(x.select("frame", *extra, key))


def read_trajectory(spark: SparkSession, trajectory_file: str, contacts_file: str, cutoff_distance: float = 1.2, max_frames: int | None = None, output_csv: str | None = None) -> Rows:
    """frame, contacts, q, contact_list, clusters_filling of every frame."""
    t = Trajectory(spark, trajectory_file, contacts_file)
    x = t.read_trajectory(cutoff_distance, max_frames, write=False)
    if output_csv:
        sinks.write_parsed(x, output_csv)
    return Rows(x.select("frame", "contacts", "q", "contact_list", "clusters_filling"))


def summarize_trajectory(spark: SparkSession, trajectory_file: str, window_size: int = 10_000, cutoff: float | None = None, output_csv: str | None = None) -> Rows:
    with kept(read_parsed(spark, _there(sinks.parsed_path(trajectory_file))).select(*NUMBERS)) as own:
        x = series.summarize_values(formation.filling_long(_not_empty(own, "the parsed trajectory")), window_size, cutoff)
        sinks.write_summary(x, output_csv or sinks.summary_path(trajectory_file, cutoff), clusters=_named(own))
    return _rows(x, "cluster_means", "")


def smooth(spark: SparkSession, trajectory_file: str, window_size: int = 100, output_csv: str | None = None, parsed_csv: str | None = None) -> Rows:
    with kept(read_parsed(spark, _there(parsed_csv or sinks.parsed_path(trajectory_file))).select(*NUMBERS)) as own:
        q, x = _smoothed(_not_empty(own, "the parsed trajectory"), window_size)
        sinks.write_smoothed(q, x, output_csv or sinks.smoothed_path(trajectory_file, window_size), clusters=_named(own))
    return _rows(x.join(q, ["traj_id", "frame"]), "cluster_smooth", "_smooth", ("q_smooth",))


def classify(spark: SparkSession, trajectory_file: str, summary_csv: str | None = None, output_path: str | None = None, cutoff: float = 0.5) -> list[int]:
    x = ordering.with_index(read_summary(spark, _there(summary_csv or sinks.summary_path(trajectory_file, cutoff))))
    _not_empty(x.filter("cluster <> 0"), "the summary")
    found = [r["cluster"] for r in ordering.formation_order(x).orderBy("rank").collect()]
    sinks.write_order(found, output_path or sinks.class_path(trajectory_file))
    return found
