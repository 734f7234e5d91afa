"""Command line: ``python -m residua trajectory|contacts COMMAND FILE [options]``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .api import ContactMap, Trajectory, smooth
from .operators.ordering import with_index
from .sources.formats import formats
from .sources.sinks import smoothed_path, summary_path
from .sources.tables import read_parsed, read_summary


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="residua", description=__doc__)
    kinds = top.add_subparsers(dest="kind", required=True)
    trajectory = kinds.add_parser("trajectory").add_subparsers(dest="command", required=True)
    contacts = kinds.add_parser("contacts").add_subparsers(dest="command", required=True)

    def command(group, name: str, *options: str):
        p = group.add_parser(name)
        p.add_argument("file")
        for o in options:
            p.add_argument(*OPTIONS[o][0], **OPTIONS[o][1])
        return p

    read = ("contacts", "cutoff-distance", "max-frames", "format")
    drawing = ("output-format", "no-show")
    command(trajectory, "parse", *read, "window-size", "cutoff", "animate", "output-format")
    command(trajectory, "read", *read, "output")
    command(trajectory, "draw", *read, "csv", "smoothing", *drawing)
    command(trajectory, "smooth", "smoothing", "output")
    command(trajectory, "summarize", *read, "csv", "window-size", "maybe-cutoff", "output-csv", "plot", *drawing)
    command(trajectory, "plot-summary", *read, "csv", "summary-csv", "window-size", "maybe-cutoff", *drawing)
    command(trajectory, "classify", *read, "csv", "summary-csv", "window-size", "cutoff", "output")
    command(trajectory, "animate", *read, "csv", "interval", "animation-format", "fps")
    command(contacts, "parse", "clusters", "cutoff-size", "no-halves", "output-name", "no-draw", *drawing)
    command(contacts, "draw", "output-name", *drawing)
    return top


OPTIONS = {
    "contacts": (["--contacts", "-c"], {"required": True}),
    "cutoff-distance": (["--cutoff-distance"], {"type": float, "default": 1.2}),
    "max-frames": (["--max-frames"], {"type": int}),
    "format": (["--format"], {"choices": formats(), "default": "pdb", "help": "of the trajectory"}),
    "window-size": (["--window-size", "-w"], {"type": int, "default": 10_000}),
    "smoothing": (["--window-size", "-w"], {"type": int, "default": 100}),
    "cutoff": (["--cutoff"], {"type": float, "default": 0.5}),
    "maybe-cutoff": (["--cutoff"], {"type": float}),
    "animate": (["--animate"], {"action": "store_true"}),
    "csv": (["--csv"], {}),
    "summary-csv": (["--summary-csv"], {}),
    "output-csv": (["--output-csv"], {}),
    "output": (["--output", "-o"], {}),
    "plot": (["--plot"], {"action": argparse.BooleanOptionalAction, "default": False}),
    "output-format": (["--output-format"], {"choices": ["png", "svg"], "default": "png", "type": str.lower}),
    "no-show": (["--no-show"], {"action": "store_true", "help": "accepted for scripts that say so: drawings go to files and are never shown"}),
    "interval": (["--interval"], {"type": int, "default": 50}),
    "animation-format": (["--output-format"], {"choices": ["gif", "mp4"], "default": "gif"}),
    "fps": (["--fps"], {"type": int, "default": 20}),
    "clusters": (["--clusters"], {"type": int, "default": 10}),
    "cutoff-size": (["--cutoff-size"], {"type": int, "default": 5}),
    "no-halves": (["--no-halves"], {"action": "store_true", "help": "clusters are connected parts only; too few of them are not halved"}),
    "output-name": (["--output-name"], {}),
    "no-draw": (["--no-draw"], {"action": "store_true"}),
}


def run(a: argparse.Namespace, spark: SparkSession) -> None:
    if a.kind == "contacts":
        m = ContactMap(spark, a.file, a.clusters, a.cutoff_size, not a.no_halves) if a.command == "parse" else ContactMap.of_csv(spark, a.file)
        if a.command == "parse":
            print(m.save(a.output_name))
            m.contacts.orderBy("ord").select("i", "j", "r6", "r12", "r", "cluster").show(5)
        print(m.stats())
        if a.command == "draw" or not a.no_draw:
            print(m.draw(a.output_name, output_format=a.output_format)[1])
        return
    if a.command == "smooth":  # of a parsed CSV
        out = a.output or smoothed_path(a.file, a.window_size)
        smooth(spark, a.file, a.window_size, out, a.file)
        print(f"{spark.read.csv(os.path.abspath(out), header=True).count()} frames in {out}")
        return
    t = Trajectory(spark, a.file, a.contacts, format=a.format)
    if a.command == "parse":
        print(",".join(map(str, t.parse(a.cutoff_distance, a.max_frames, a.window_size, a.cutoff, a.animate, a.output_format))))
        return
    if a.command == "read":
        t.read_trajectory(a.cutoff_distance, a.max_frames, output=a.output)
        own = read_parsed(spark, os.path.abspath(a.output or t.file("_parsed.csv")))  # what was written, so that nothing is found out twice
        print(t.stats(own))
        first = [r["frame"] for r in own.select("frame").orderBy("frame").limit(5).collect()]
        own.filter(F.col("frame").isin(first)).orderBy("frame").show(5, truncate=80)
        return
    if not getattr(a, "summary_csv", None):  # a summary has all that is drawn or ordered
        t.parsed(a.cutoff_distance, a.max_frames, a.csv)
    if a.command == "draw":
        print(t.draw(a.window_size, a.csv, output_format=a.output_format)[1])
    elif a.command == "summarize":
        t.summarize_trajectory(a.window_size, a.cutoff, a.csv, a.output_csv)
        written = os.path.abspath(a.output_csv or summary_path(t.path, a.cutoff))
        with_index(read_summary(spark, written)).select("traj_id", "widx", "frame", "cluster", "value").orderBy("frame", "cluster").show(5)
        if a.plot:
            print(t.plot_summary(a.output_csv, a.cutoff, a.output_format)[1])
    elif a.command == "plot-summary":
        if not a.summary_csv:
            t.summarize_trajectory(a.window_size, a.cutoff, a.csv)
        print(t.plot_summary(a.summary_csv, a.cutoff, a.output_format)[1])
        if a.cutoff is not None:
            t.summary_counts(a.summary_csv or t.file(f"_summary_binary_{a.cutoff}.csv"), a.cutoff).orderBy("cluster").show()
    elif a.command == "classify":
        if not a.summary_csv:
            t.summarize_trajectory(a.window_size, a.cutoff, a.csv)
        print(",".join(map(str, t.classify(a.summary_csv, a.cutoff, a.output))))
    else:
        print(t.animate(a.csv, a.output_format, a.interval, a.fps)[2])


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    try:
        run(a, spark or SparkSession.builder.appName("residua").getOrCreate())
    except Exception as e:  # a command line tells what went wrong and fails
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
