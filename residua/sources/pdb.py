"""Multi-model PDB text as frames, one row per model, read by byte ranges.

Files are cut into ranges.  A first pass over the bytes finds the lines that begin with MODEL or ENDMDL and makes an index:
file, byte offset and length, and frame number of each model that counts.  What counts can be told where a model ends,
so the index needs no window; of repeated numbers the last offset is a plain aggregate.  A second pass reads the models
that are left, neighbours together, and parses each once, with numpy.  Coordinates are never shuffled.

The index can be saved beside the files: then ``max_frames`` reads the bytes of its models only.  Without one, a limit
stops the first pass of each file as soon as it has enough models.

Workers open files themselves, through pyarrow's file systems (local paths, HDFS, object stores); files are plain text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..operators.series import positioned
from .files import listed_files, opened, wide_folders

#: Bytes that the first pass holds at a time, those of a line's head, and those that the second pass parses at once.
BLOCK, HEAD, PIECE = 1 << 20, 256, 4 << 20
#: Bytes of the shortest blocks of the first pass, those of the shortest ranges by default, and rows that go back to Spark at once.
SMALL, SHORT, ROWS = 1 << 12, 1 << 20, 1 << 10
#: What opening a file costs, in bytes: so many files are a task.
OPEN = 1 << 16
#: Entries of the folders that Spark's own listing takes, at most.
LISTED = 1 << 10
INDEX = "traj_id string, path string, offset bigint, length bigint, frame int, head string, lone boolean"
FRAMES = "traj_id string, frame int, coords map<int,struct<x:double,y:double,z:double>>"
NUMBER = re.compile(rb"[+-]?\d+")


def marks(file, size: int, start: int, step: int = BLOCK) -> Iterator[tuple[int, bytes | None]]:
    """offset and head of the lines from ``start`` on that begin with MODEL or ENDMDL; after each block of ``step`` bytes how far it went, and None."""
    at = max(0, start - 1)
    while at < size:
        block = file.read_at(min(step + HEAD, size - at), at)
        found = []
        for word in (b"\nMODEL", b"\nENDMDL"):
            k = block.find(word)
            while 0 <= k < step:
                found.append(k + 1)
                k = block.find(word, k + 1)
        if at == 0 and start == 0 and block.startswith((b"MODEL", b"ENDMDL")):
            found.append(0)
        for k in sorted(found):
            yield at + k, block[k : k + HEAD].split(b"\n", 1)[0].rstrip(b"\r")
        at += step
        yield min(at, size), None


def number_of(head: bytes) -> int | None:
    """The second word of a MODEL line, if it is a 32-bit number."""
    words = head.split()
    if len(words) > 1 and NUMBER.fullmatch(words[1]) and -(2**31) <= (n := int(words[1])) < 2**31:
        return n
    return None


def models(file, size: int, start: int, stop: int, most: int | None = None) -> Iterator[tuple[int, int, int | None, bytes, bool]]:
    """offset, length, number, head, lone of the models that begin in [start, stop) and count.

    A model counts if it is closed, has a CA atom, or is not the file's last; a file without MODEL is one, lone, if it has
    an atom, and belongs to the range from 0.  ``most``: the file's models up to this many different numbers.
    """
    now, closed, head, any_, seen = None, False, b"", False, set()
    for offset, line in marks(file, size, start, max(SMALL, min(BLOCK, stop - start))):  # of a short range not much more is read than it has
        if line is None:
            if now is None and offset >= stop and (any_ or start):
                return
            continue
        if line.startswith(b"E"):
            closed = True
            continue
        if now is not None:
            yield now, offset - now, number_of(head), head, False
            seen.add(number_of(head))
        if offset >= stop or most is not None and len(seen) >= most:
            return
        now, closed, head, any_ = offset, False, line, True
    if now is not None:
        if closed or atoms(file.read_at(size - now, now), [0], [False])[0].size:
            yield now, size - now, number_of(head), head, False
    elif start == 0 and not any_ and atoms(file.read_at(size, 0), [0], [True])[0].size:
        yield 0, size, 1, b"", True


def numbers(fields: np.ndarray, allowed: bytes, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values of fixed-width text fields (rows of bytes) and which of them are numbers."""
    ok = np.isin(fields, np.frombuffer(allowed, dtype=np.uint8)).all(axis=1)
    text = np.ascontiguousarray(fields).view(f"S{fields.shape[1]}").ravel()
    out = np.zeros(len(text), dtype=kind)
    try:
        out[ok] = text[ok].astype(kind)
    except ValueError:  # something looks like a number and isn't one
        for k in np.flatnonzero(ok).tolist():
            try:
                out[k] = kind(text[k])
            except ValueError:
                ok[k] = False
    return out, ok


def atoms(data: bytes, starts: list[int], lone: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """model (its place in ``starts``), residue and point of the CA atoms in whole models, by model and residue.

    ``starts``: where models begin in ``data``.  Lines after a model's ENDMDL don't count, unless it is lone; malformed
    lines don't either; of equal residues of a model the last counts.
    """
    x = np.frombuffer(data, dtype=np.uint8)
    begin = np.r_[0, np.flatnonzero(x == 10) + 1]
    end = np.r_[begin[1:] - 1, len(x)]
    model = np.searchsorted(np.array(starts), begin, side="right") - 1
    cut = np.zeros(len(begin), dtype=np.int64)
    if len(x):
        cut[1:] = (x[end[1:] - 1] == 13) & (end[1:] > begin[1:])
        cut[0] = end[0] > 0 and x[end[0] - 1] == 13
    long = np.flatnonzero(end - cut - begin >= 54)
    is_atom = np.ones(len(long), dtype=bool)
    for k, c in enumerate(b"ATOM"):
        is_atom &= x[begin[long] + k] == c
    line = long[is_atom]
    places = np.flatnonzero((x[:-3] == 32) & (x[1:-2] == 67) & (x[2:-1] == 65) & (x[3:] == 32))
    has = np.zeros(len(begin), dtype=bool)
    of = np.searchsorted(begin, places, side="right") - 1
    has[of[places + 4 <= end[of]]] = True
    line = line[has[line]]
    closing = np.flatnonzero((end - begin >= 6) & (x[np.minimum(begin, max(0, len(x) - 1))] == 69)) if len(x) else np.empty(0, np.int64)
    closing = closing[[data.startswith(b"ENDMDL", s) for s in begin[closing].tolist()]] if len(closing) else closing
    first = np.full(len(starts), len(begin), dtype=np.int64)
    inside = closing[model[closing] >= 0]
    np.minimum.at(first, model[inside], inside)
    first[np.array(lone, dtype=bool)] = len(begin)
    line = line[(model[line] >= 0) & (line < first[model[line]])]
    if not len(line):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 3))
    fields = x[begin[line][:, None] + np.arange(22, 54)]
    residue, ok = numbers(fields[:, :4], b"+-0123456789 ", int)
    point = np.empty((len(line), 3))
    for k in range(3):
        point[:, k], good = numbers(fields[:, 8 * k + 8 : 8 * k + 16], b"+-.0123456789eE infatyINFATY", float)
        ok &= good
    own, residue, point = model[line][ok], residue[ok], point[ok]
    order = np.lexsort((residue, own))  # stable: of equal residues the later line comes later
    own, residue, point = own[order], residue[order], point[order]
    last = np.r_[(own[1:] != own[:-1]) | (residue[1:] != residue[:-1]), True] if len(own) else np.empty(0, bool)
    return own[last], residue[last], point[last]


def range_bytes(spark: SparkSession, files: DataFrame) -> tuple[int, int]:
    """Bytes of a task's range by default, and tasks, for files (with size): as Spark cuts files for its own readers, by cores, but no range is longer than its longest."""
    r = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count("*").alias("n")).first()
    most = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    total = r["size"] + OPEN * r["n"]
    wide = min(most, max(SHORT, total // (2 * spark.sparkContext.defaultParallelism)))
    return wide, 1 + total // wide


def listed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """traj_id, path, size of the files, as Spark lists them; their content isn't read.

    Spark's own listing is kept whole by the driver, so folders with many entries, or with folders, are listed by executors.
    """
    if (roots := wide_folders(spark, [path] if isinstance(path, str) else path, LISTED)) is not None:
        return listed_files(spark, roots)
    name = F.regexp_replace("_metadata.file_path", "^file:/(?!/)", "file:///")  # as the other sources have it
    return spark.read.format("binaryFile").load(path).select(name.alias("traj_id"), "path", F.col("length").alias("size"))


def index_pdb(spark: SparkSession, path: str | list[str], max_frames: int | None = None, wide: int | None = None) -> DataFrame:
    """traj_id, path, offset, length, frame, head, lone: the models that count, repeated numbers among them.

    Written as Parquet it is the ``index`` of read_pdb.  With ``max_frames`` each file is scanned from its beginning, in
    one task, until it has enough; else files are scanned in ranges of ``wide`` bytes (Spark's for files by default).
    """
    return _indexed(spark, files := listed(spark, path), max_frames, wide, *range_bytes(spark, files))


def _indexed(spark: SparkSession, files: DataFrame, max_frames: int | None, wide: int | None, usual: int, n: int) -> DataFrame:
    """index_pdb of listed files in ``n`` tasks, which take several ranges each if these are shorter than usual."""
    wide = wide or usual
    step = F.col("size") if max_frames is not None else F.lit(wide)
    ranges = files.filter("size > 0").withColumn("start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, step.cast("bigint"))))
    ranges = ranges.withColumn("stop", F.least(F.col("start") + step, F.col("size")))
    if max_frames is not None and max_frames <= 0:
        ranges = ranges.limit(0)

    def batch(rows: list[tuple]):
        import pyarrow as pa

        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["traj_id", "path", "offset", "length", "frame", "head", "lone"])

    def run(batches):
        file = now = None
        rows: list[tuple] = []
        for b in batches:
            for traj, name, size, start, stop in zip(*(b.column(k).to_pylist() for k in ("traj_id", "path", "size", "start", "stop")), strict=True):
                if name != now:
                    if file:
                        file.close()
                    file, now = opened(name), name
                for o, n, k, h, lone in models(file, size, start, stop, max_frames):
                    rows.append((traj, name, o, n, k, h.decode("utf-8", "replace"), lone))
                    if len(rows) >= ROWS:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    ship(spark)
    together = F.floor(F.col("start") / F.lit(max(wide, usual))).alias("together")
    x = ranges.select("traj_id", "path", "size", "start", "stop", together).repartition(n, "path", "together").sortWithinPartitions("path", "start")
    return x.drop("together").mapInArrow(run, INDEX)


def kept_models(index: DataFrame, max_frames: int | None = None, width: int = 1 << 26) -> DataFrame:
    """traj_id, frame, path, offset, length, lone: one model for each number, its last, up to ``max_frames`` numbers in file order."""
    if max_frames is not None:
        first = index.groupBy("traj_id", "frame").agg(F.min("offset").alias("first"))
        limit = positioned(first, ["traj_id"], "first", width).filter(F.col("pos") == max_frames - 1).select("traj_id", F.col("first").alias("limit"))
        index = index.join(limit, "traj_id", "left").filter(F.lit(max_frames > 0) & (F.col("limit").isNull() | (F.col("offset") <= F.col("limit"))))
    model = F.max_by(F.struct("path", "length", "lone", "head"), "offset").alias("m")
    x = index.groupBy("traj_id", "frame").agg(F.max("offset").alias("offset"), model)
    frame = F.coalesce("frame", F.raise_error(F.concat(F.lit("no frame number in: "), F.col("m.head"))).cast("int"))
    return x.select("traj_id", frame.alias("frame"), "m.path", "offset", "m.length", "m.lone")


def parsed(models_: DataFrame, n: int, wide: int) -> DataFrame:
    """traj_id, frame, coords of models by their places; models of one range of a file go to one task and are read together."""

    def batch(rows: list[tuple]):
        import pyarrow as pa

        with opened(rows[0][2]) as file:
            at = rows[0][3]
            data = file.read_at(rows[-1][3] + rows[-1][4] - at, at)
        model, residue, point = atoms(data, [r[3] - at for r in rows], [r[5] for r in rows])
        offsets = pa.array(np.searchsorted(model, np.arange(len(rows) + 1)), pa.int32())
        points = pa.StructArray.from_arrays([pa.array(point[:, k]) for k in range(3)], names=["x", "y", "z"])
        coords = pa.MapArray.from_arrays(offsets, pa.array(residue, pa.int32()), points)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), coords], names=["traj_id", "frame", "coords"])

    def run(batches):
        import pyarrow as pa

        rows: list[tuple] = []
        done: list = []  # batches of short files, which go on together
        n = size = 0

        def joined():
            return done[0] if len(done) == 1 else pa.Table.from_batches(done).combine_chunks().to_batches()[0]

        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in ("traj_id", "frame", "path", "offset", "length", "lone")), strict=True):
                if rows and (rows[-1][2] != r[2] or rows[-1][3] + rows[-1][4] != r[3] or r[3] + r[4] - rows[0][3] > PIECE):
                    done.append(batch(rows))
                    n, size, rows = n + done[-1].num_rows, size + done[-1].nbytes, []
                    if n >= ROWS or size >= PIECE:
                        yield joined()
                        n, size, done = 0, 0, []
                rows.append(r)
        if rows:
            done.append(batch(rows))
        if done:
            yield joined()

    ship(models_.sparkSession)
    x = models_.withColumn("part", F.floor(F.col("offset") / F.lit(wide))).repartition(n, "path", "part").sortWithinPartitions("path", "offset")
    return x.select("traj_id", "frame", "path", "offset", "length", "lone").mapInArrow(run, FRAMES)


def read_pdb(spark: SparkSession, path: str | list[str], max_frames: int | None = None, index: str | DataFrame | None = None, wide: int | None = None) -> DataFrame:
    """traj_id (the file's path), frame, coords of every model that counts.

    With a MODEL line, text before it and text after a model's ENDMDL is dropped; a model counts if it is closed, has a
    CA atom, or is not the file's last.  A file without MODEL is frame 1 if it has an atom.  A repeated number replaces
    the earlier model.  ``max_frames`` keeps the first so many different numbers in file order.  A MODEL line without a
    number raises.  ``index``: what index_pdb made of these files, or where it was written as Parquet; then ``path``
    isn't looked at, and only the models that count are read.  ``wide``: bytes of a task's range.
    """
    if index is None:
        files = listed(spark, path)
        usual, n = range_bytes(spark, files)
        return parsed(kept_models(_indexed(spark, files, max_frames, wide, usual, n)), n, max(wide or 0, usual))
    kept = kept_models(spark.read.schema(INDEX).parquet(index) if isinstance(index, str) else index, max_frames)
    usual, n = range_bytes(spark, kept.groupBy("path").agg(F.sum("length").alias("size")))
    return parsed(kept, n, max(wide or 0, usual))
