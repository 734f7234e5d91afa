"""Contacts in frames for maps too large to broadcast: both are cut into blocks of residues and meet block by block.

The residues of a map are cut into at most BLOCKS blocks, so contacts fall into at most BLOCKS squared pairs of blocks,
and a pair with many contacts into chunks.  A frame is packed once: for each pair with contacts it sends the points of
these two blocks, in place of single residues.  A place is a pair's chunk and one of ``salts`` classes of frames; it gets
the chunk's contacts first, then its frames one by one, so what a task holds is one chunk and a few frames, however many
frames there are.  No row is made for a contact that isn't formed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship

#: Blocks of a map at most, residues of a block at least, contacts of a chunk about, classes of frames.
BLOCKS, RESIDUES, CHUNK, SALTS = 128, 64, 20_000, 32
#: Contacts of frames that are evaluated at once, and bytes of packed frames passed on at once.
CELLS, PACKED = 1 << 20, 4 << 20
PLACE = ["a", "b", "chunk", "salt"]


def met(frames: DataFrame, contacts: DataFrame, cutoff: float = 1.2, every: bool = False, blocks: int = BLOCKS, residues: int = RESIDUES, chunk: int = CHUNK, salts: int = SALTS) -> DataFrame:
    """traj_id, frame, ord, i, j, cluster of the formed contacts; with ``every`` of all contacts, with formed.

    A contact with an absent residue isn't formed, nor is one without a distance.  What the driver sees of the contacts
    is their number in each pair of blocks.
    """
    kind = frames.schema["traj_id"].dataType.simpleString()
    schema = f"traj_id {kind}, frame int, ord bigint, i int, j int, cluster int" + (", formed boolean" if every else "")
    c = contacts.select("ord", "i", "j", "r", "cluster")
    low, high = c.agg(F.min(F.least("i", "j")), F.max(F.greatest("i", "j"))).first()
    if low is None:
        return frames.sparkSession.createDataFrame([], schema)
    wide = max(residues, -(-(high - low + 1) // blocks))
    c = c.withColumns({"a": F.floor((F.col("i") - low) / wide).cast("int"), "b": F.floor((F.col("j") - low) / wide).cast("int")})
    pairs = [(r["a"], r["b"], -(-r["count"] // chunk)) for r in c.groupBy("a", "b").count().orderBy("a", "b").collect()]  # at most blocks squared
    counts = frames.sparkSession.createDataFrame(pairs, "a int, b int, chunks int")
    c = c.join(F.broadcast(counts), ["a", "b"]).withColumn("chunk", F.pmod(F.xxhash64("ord", "i", "j"), F.col("chunks")).cast("int"))
    c = c.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(*PLACE, F.lit(0).alias("role"), F.lit(None).cast(kind).alias("traj_id"), F.lit(None).cast("int").alias("frame"), "ord", "i", "j", "r", "cluster", F.lit(None).cast("binary").alias("points"))
    ship(frames.sparkSession)
    sent = _packed(frames, kind, pairs, low, wide, salts)
    both = c.unionByName(sent, allowMissingColumns=True)
    return _evaluated(both.repartition(*PLACE).sortWithinPartitions(*PLACE, "role"), schema, low, wide, cutoff, every)


def _packed(frames: DataFrame, kind: str, pairs: list[tuple[int, int, int]], low: int, wide: int, salts: int) -> DataFrame:
    """A row for each frame, pair of blocks and chunk: the points of both blocks, absent ones as NaN."""
    used = sorted({k for p in pairs for k in p[:2]})
    place = {k: n for n, k in enumerate(used)}
    table = np.full(max(used) + 1, -1)
    table[used] = np.arange(len(used))

    def run(batches):
        import pyarrow as pa

        def rows(out):
            columns = list(zip(*out, strict=True))
            kinds = (pa.int32(),) * 5 + (traj, pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*PLACE, "role", "traj_id", "frame", "points"])

        for b in batches:
            coords, traj, out, size = b.column("coords"), b.column("traj_id").type, [], 0
            offsets, keys = coords.offsets.to_numpy(), coords.keys.to_numpy(zero_copy_only=False).astype(np.int64)
            points = np.stack([coords.items.field(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
            for k, (t, f) in enumerate(zip(b.column("traj_id").to_pylist(), b.column("frame").to_pylist(), strict=True)):
                own = slice(offsets[k], offsets[k + 1])
                at = keys[own] - low
                inside = (at >= 0) & (at < len(table) * wide)
                at, of = at[inside], table[at[inside] // wide]
                packed = np.full((len(used), wide, 3), np.nan)
                packed[of[of >= 0], (at % wide)[of >= 0]] = points[own][inside][of >= 0]
                blobs = [p.tobytes() for p in packed]
                for i, j, chunks in pairs:
                    data = blobs[place[i]] + blobs[place[j]]
                    for n in range(chunks):
                        out.append((i, j, n, f % salts, 1, t, f, data))
                        size += len(data)
                        if size > PACKED:
                            yield rows(out)
                            out, size = [], 0
            if out:
                yield rows(out)

    return frames.select("traj_id", "frame", "coords").mapInArrow(run, f"a int, b int, chunk int, salt int, role int, traj_id {kind}, frame int, points binary")


def _evaluated(both: DataFrame, schema: str, low: int, wide: int, cutoff: float, every: bool) -> DataFrame:
    """The contacts of each place in its frames; a place's contacts come before its frames."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        place, parts, held = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (*PLACE, "role")])
            cuts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, batch.num_rows].tolist()
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                own = batch.slice(s, e - s)
                if place != (now := tuple(keys[:4, s].tolist())):
                    place, parts, held = now, [], None
                if keys[4, s] == 0:
                    parts.append(own.select(["ord", "i", "j", "r", "cluster"]))
                    held = None
                    continue
                if not parts:
                    continue
                if held is None:
                    t = pa.Table.from_batches(parts).combine_chunks()
                    i, j, r = (t.column(k).to_numpy() for k in ("i", "j", "r"))
                    held = t, i - low - place[0] * wide, j - low - place[1] * wide, r * cutoff
                table, i, j, near = held
                step = max(1, CELLS // len(i))
                for k in range(0, own.num_rows, step):
                    some = own.slice(k, step)
                    x = np.stack([np.frombuffer(p.as_buffer(), dtype=np.float64) for p in some.column("points")]).reshape(some.num_rows, 2, wide, 3)
                    d = x[:, 0, i, 0] - x[:, 1, j, 0]
                    total = d * d
                    for axis in (1, 2):
                        d = x[:, 0, i, axis] - x[:, 1, j, axis]
                        total += d * d
                    formed = np.sqrt(total) < near  # never where a point or a distance is NaN
                    f, c = np.indices(formed.shape).reshape(2, -1) if every else np.nonzero(formed)
                    columns = [pc.take(some.column(n), pa.array(f)) for n in ("traj_id", "frame")] + [pc.take(table.column(n), pa.array(c)).combine_chunks() for n in ("ord", "i", "j", "cluster")]
                    if every:
                        columns.append(pa.array(formed.ravel()))
                    yield pa.RecordBatch.from_arrays(columns, names=["traj_id", "frame", "ord", "i", "j", "cluster"] + (["formed"] if every else []))

    return both.mapInArrow(run, schema)
