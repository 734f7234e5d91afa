"""Files as Hadoop's paths name them, folders of ordered part files that become one file, and many files, listed and written by executors."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import shared_folder, ship

#: Bytes that are held while files are put together.
BLOCK = 1 << 22
#: Rows that go back to Spark at once, and folders that a task lists.
ROWS, FOLDERS = 1 << 12, 4


def located(path: str) -> tuple:
    """A path's file system, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:") or path.startswith("/"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def opened(path: str):
    """A file that can be read at any place."""
    system, inner = located(path)
    return system.open_input_file(inner)


@contextmanager
def written_parts(df: DataFrame, source: str) -> Iterator[list]:
    """``df``, whose partitions are in order, written by executors to a new folder of the shared one; its part files, open in order, while the block runs."""
    from pyarrow import fs

    path = f"{shared_folder(df.sparkSession)}/parts-{uuid.uuid4().hex}"
    df.write.format(source).save(path)
    system, inner = located(path)
    names = sorted(f.path for f in system.get_file_info(fs.FileSelector(inner)) if os.path.basename(f.path).startswith("part-"))
    yield (system.open_input_file(n) for n in names)
    system.delete_dir(inner)


def write_lines(lines: DataFrame, path: str, head: str = "") -> None:
    """One file of the only column of ``lines``, whose partitions are in order, after ``head``.

    Executors write the lines; here their files are only put one after the other, a block at a time, so no row passes
    through Spark's driver.
    """
    system, inner = located(path)
    system.create_dir(os.path.dirname(inner))
    with written_parts(lines, "text") as files, system.open_output_stream(inner) as out:
        out.write(head.encode())
        for file in files:
            with file:
                while block := file.read(BLOCK):
                    out.write(block)


def wide_folders(spark: SparkSession, paths: list[str], most: int) -> list[str] | None:
    """The paths as their file systems name them, if there is a folder among them with over ``most`` entries or with folders; else, or with patterns among them, None."""
    conf, names, wide = spark._jsc.hadoopConfiguration(), [], False
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        system = at.getFileSystem(conf)
        if set("{}[]*?\\") & set(p) or not system.exists(at):
            return None
        names.append(system.makeQualified(at).toString())
        entries, n = system.listStatusIterator(at), 0
        while not wide and entries.hasNext():
            n += 1
            wide = n > most or entries.next().isDirectory()
    return names if wide else None


def entries_of(name: str, top: bool) -> Iterator[tuple[str, str, int, bool]]:
    """traj_id, path, size and whether it is a folder, of the file ``name``, or of what the folder ``name`` has as Spark sees it, without hidden ones.

    Of the folders in one that was asked for (``top``) only those named column=value count; others beside them are an error if there is a file in them.
    """
    from pyarrow import fs

    system, inner = located(name)
    own = system.get_file_info(inner)
    is_folder = lambda f: f.type == fs.FileType.Directory
    found = system.get_file_info(fs.FileSelector(inner)) if is_folder(own) else [own]
    if is_folder(own):
        found = [f for f in found if not (f.base_name.startswith(".") or f.base_name.startswith("_") and "=" not in f.base_name or f.base_name.endswith("._COPYING_"))]
    plain = [f for f in found if top and is_folder(f) and "=" not in f.base_name]
    if plain and any(is_folder(f) and "=" in f.base_name for f in found):
        for f in plain:
            if not all(map(is_folder, system.get_file_info(fs.FileSelector(f.path, recursive=True)))):
                raise ValueError(f"folder beside folders named column=value: {f.path}")
    for f in found:
        if not (top and is_folder(f) and "=" not in f.base_name):
            path = name + f.path[len(inner):]
            yield url(path), path, f.size or 0, is_folder(f)


def url(path: str) -> str:
    """The path as Spark's _metadata.file_path has it, local ones with three slashes."""
    at = re.sub("[\x00-\x7f]+", lambda x: quote(x[0], safe="_-!.~'()*,;:$&+=/@"), path)
    return re.sub("^file:/(?!/)", "file:///", at)


def listed_files(spark: SparkSession, names: list[str]) -> DataFrame:
    """traj_id, path, size of the files in these folders and in their folders named column=value; executors list a level at a time."""

    def run(batches, top):
        import pyarrow as pa

        rows: list[tuple] = []
        kinds = (pa.string(), pa.string(), pa.int64(), pa.bool_())

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["traj_id", "path", "size", "folder"])

        for b in batches:
            for name in b.column(0).to_pylist():
                for row in entries_of(name, top):
                    rows.append(row)
                    if len(rows) >= ROWS:
                        yield batch()
                        rows.clear()
        if rows:
            yield batch()

    ship(spark)
    at, levels = f"{shared_folder(spark)}/listed-{uuid.uuid4().hex}", []
    now, n = spark.createDataFrame([(x,) for x in names], "path string"), len(names)
    while n:
        kind = "traj_id string, path string, size bigint, folder boolean"
        now.repartition(1 + n // FOLDERS, "path").mapInArrow(partial(run, top=not levels), kind).write.parquet(to := f"{at}/{len(levels)}")
        levels.append(to)
        now = spark.read.schema(kind).parquet(to).filter("folder").select("path")
        n = now.count()
    return spark.read.schema(kind).parquet(*levels).filter("not folder").select("traj_id", "path", "size")


def write_files(files: DataFrame, path: str) -> int:
    """Each row of ``files`` (folder, name, value) as the file ``name`` with the text ``value`` in a folder of the folder ``path``; their number.

    Executors write them, a partition a task; a task that is repeated writes the same files again.
    """

    def run(batches):
        import pyarrow as pa

        system, inner = located(path)
        made: set[str] = set()
        for b in batches:
            for folder, name, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if folder not in made:
                    system.create_dir(f"{inner}/{folder}")
                    made.add(folder)
                at = f"{inner}/{folder}/.{name}-{uuid.uuid4().hex}"
                with system.open_output_stream(at) as out:
                    out.write(value.encode())
                system.move(at, f"{inner}/{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    ship(files.sparkSession)
    return files.select("folder", "name", "value").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
