"""Writers of the text formats that other tools read, and their file names.

Each writes one file: a trajectory's frames in order.  Executors write ordered ranges of frames, whose bytes are then put
one after the other.  With ``parts`` the result is a folder of such ranges instead, each with a header.  No row passes
through Spark's driver.  Parquet is the format for everything else.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import list_text, map_text, number_text
from ..operators.series import wide
from .files import write_lines


def output_path(source: str, suffix: str, directory: str | None = None) -> str:
    """{directory}/{stem}{suffix}; the source's own directory by default."""
    stem = os.path.splitext(os.path.basename(source))[0]
    return os.path.join(directory or os.path.dirname(source), f"{stem}{suffix}")


def parsed_path(source: str) -> str:
    return output_path(source, "_parsed.csv")


def smoothed_path(source: str, window: int) -> str:
    return output_path(source, f"_{window}_smoothed.csv")


def summary_path(source: str, cutoff: float | None = None) -> str:
    return output_path(source, "_summary.csv" if cutoff is None else f"_summary_binary_{cutoff}.csv")


def class_path(source: str) -> str:
    return output_path(source, "_class.txt")


def _line(columns: list[str]) -> Column:
    """The columns as a line of CSV; values with a comma, a quote or a line end are quoted."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    return F.concat_ws(",", *(F.when(text(c).rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text(c)) for c in columns))


def _write(df: DataFrame, order: str, columns: list, path: str, parts: bool) -> None:
    """These columns of ``df``, by the column ``order``, as one CSV or as a folder of ordered ones."""
    if parts:
        x = df.repartitionByRange(order).sortWithinPartitions(order).select(*columns)
        x.write.options(header=True, escape='"', emptyValue="", nullValue="").csv(path)
    else:
        x = df.orderBy(order).select(*columns)
        write_lines(x.select(_line(x.columns).alias("value")), os.path.abspath(path), ",".join(x.columns) + "\n")


def write_parsed(results: DataFrame, path: str, parts: bool = False) -> None:
    columns = ["frame", "contacts", number_text(F.col("q")).alias("q"), list_text(F.col("contact_list")).alias("contact_list"), map_text(F.col("clusters_filling")).alias("clusters_filling")]
    _write(results, "frame", columns, path, parts)


def clusters_of(series: DataFrame) -> list[int]:
    """The distinct clusters, few, ascending."""
    return [r["cluster"] for r in series.select("cluster").distinct().orderBy("cluster").collect()]


def write_summary(summary: DataFrame, path: str, parts: bool = False, clusters: list[int] | None = None) -> None:
    """``clusters``: those of the summary, if they are known without computing it."""
    own = clusters_of(summary) if clusters is None else clusters
    _write(wide(summary, ["frame"], own), "frame", ["frame", *(number_text(F.col(f"cluster_{c}")).alias(f"cluster_{c}") for c in own)], path, parts)


def write_smoothed(q: DataFrame, smoothed: DataFrame, path: str, parts: bool = False, clusters: list[int] | None = None) -> None:
    own = clusters_of(smoothed) if clusters is None else clusters
    x = q.select("frame", "q_smooth").join(wide(smoothed, ["frame"], own, "_smooth"), "frame", "left")
    _write(x, "frame", ["frame", *(number_text(F.col(c)).alias(c) for c in ("q_smooth", *(f"cluster_{c}_smooth" for c in own)))], path, parts)


def write_order(order: list[int], path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        f.write(",".join(map(str, order)) + "\n")


def write_contacts(contacts: DataFrame, path: str, parts: bool = False) -> None:
    _write(contacts, "ord", ["i", "j", *(number_text(F.col(c)).alias(c) for c in ("r6", "r12", "r")), "cluster"], path, parts)
