"""Document fingerprints: improbable-feature digests.

Every 64-byte window of a text has an entropy; windows far from the entropy that texts usually have are rare.  A window
that is the rarest one, leftmost among equals, of at least MIN_WINS of the 64 runs of 64 consecutive windows that it is
in is selected.  Its bytes' hash sets five bits of a 2048-bit Bloom filter; after PER_FILTER features a new filter
begins.  Likeness compares each filter of the shorter digest with all of the other: common bits beyond those expected
by chance, over the most there could be; the best of each, weighed by its bits, are averaged.  A filter of few features
beside full ones counts by its few bits, as does what a full filter has in common with it.

Selection looks at 127 windows around a place only, so edits leave far features alone, and pieces of a long text can be
worked on one by one, with margins, for the same result.
"""

from __future__ import annotations

import base64

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, written
from .texts import encode, ready, sha256, sliced

WINDOW = RUN = 64
MIN_WINS = 16
PER_FILTER, BITS, PROBES = 160, 2048, 5
#: C * log2(c) in 1/1024 bits for c equal bytes in a window, and its usual sum over a window of prose.
CLOGC = np.array([0, *(round(c * np.log2(c) * 1024) for c in range(1, WINDOW + 1))], dtype=np.int32)
USUAL = round(WINDOW * (6 - 4.2) * 1024)
#: Windows of less than 1 bit of entropy say nothing.
WEAK = WINDOW * 5 * 1024
FAR = np.iinfo(np.int64).max
PIECE, GAP = 1 << 17, WINDOW + RUN
#: Part of the overlap beyond chance that is taken for noise; fewest features of a filter that can stand for all of a full one beside others.
NOISE, FEW = 0.1, 16


def _rarity(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the bytes x, by its first byte: smaller is rarer; and whether it is too weak to count."""
    n = len(x)
    before, after = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.uint8)
    equal = np.empty(n, dtype=bool)
    for lag in range(1, WINDOW):
        same = np.equal(x[lag:], x[:-lag], out=equal[: n - lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    step = np.diff(CLOGC)  # what one more equal byte adds
    delta = step[before]
    delta[WINDOW:] -= step[after[:-WINDOW]]
    total = np.cumsum(delta, dtype=np.int32)[WINDOW - 1 :]  # the more equal bytes, the less entropy
    return -np.abs(total - USUAL), total > WEAK


def _select(x: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """First bytes of the selected windows; ``valid`` says which windows count. x has GAP bytes beside the windows that do."""
    rarity, weak = _rarity(x)
    place = np.arange(len(rarity), dtype=np.int64)
    code = np.where(valid & ~weak, ((rarity.astype(np.int64) + (1 << 20)) << 32) | place, FAR)
    least = code  # of runs of 64 windows, by doubling
    for k in (1, 2, 4, 8, 16, 32):
        least = np.minimum(least[:-k], least[k:])
    edge = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    wins, winner = np.diff(np.r_[edge, len(least)]), least[edge]
    return (winner[(wins >= MIN_WINS) & (winner != FAR)] & 0xFFFFFFFF).astype(np.int64)


def _hash(windows: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of 64 bytes."""
    words = np.ascontiguousarray(windows).view(np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(len(words), 0x9E3779B97F4A7C15, dtype=np.uint64)
        for k in range(words.shape[1]):
            h = (h ^ words[:, k]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
    return h


def _piece(buffer: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = _select(buffer, valid)
    return at, _hash(buffer[at[:, None] + np.arange(WINDOW)]) if len(at) else np.empty(0, np.uint64)


def features(blobs: list[bytes]) -> list[np.ndarray]:
    """The hashes of each text's features, in order; a text of which no window is selected has one, of all its bytes."""
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(blobs)
    small, size = [], 0

    def flush() -> None:
        nonlocal small, size
        if not small:
            return
        fill = b"\xff" * GAP
        buffer = np.frombuffer(fill + b"".join(blobs[k] + fill for k in small), dtype=np.uint8)
        starts = GAP + np.cumsum([0, *(len(blobs[k]) + GAP for k in small[:-1])])
        ends = starts + np.array([len(blobs[k]) for k in small]) - WINDOW + 1
        mark = np.zeros(len(buffer) + 1, dtype=np.int8)
        mark[starts], mark[ends] = 1, -1
        valid = np.cumsum(mark[: len(buffer) - WINDOW + 1]) > 0
        at, h = _piece(buffer, valid)
        cuts = np.searchsorted(at, starts)
        for k, mine in zip(small, np.split(h, cuts[1:]), strict=True):
            out[k] = mine
        small, size = [], 0

    for k, blob in enumerate(blobs):
        if 0 < len(blob) < WINDOW:
            out[k] = _hash(np.frombuffer(blob.ljust(WINDOW - 1, b"\0") + bytes([len(blob)]), dtype=np.uint8)[None, :])
        elif len(blob) > PIECE:
            found, n = [], len(blob) - WINDOW + 1
            for s in range(0, n, PIECE):
                a, b = s - GAP, s + PIECE + WINDOW + GAP
                buffer = np.frombuffer(b"\xff" * max(0, -a) + blob[max(0, a) : b] + b"\xff" * max(0, b - len(blob)), dtype=np.uint8)
                place = np.arange(len(buffer) - WINDOW + 1) + a
                at, h = _piece(buffer, (place >= 0) & (place < n))
                found.append(h[(at + a >= s) & (at + a < s + PIECE)])
            out[k] = np.concatenate(found)
        elif blob:
            if size + len(blob) + GAP > PIECE:
                flush()
            small.append(k)
            size += len(blob) + GAP
    flush()
    return [h if len(h) or not blob else np.array([xxhash.xxh3_64_intdigest(blob)], dtype=np.uint64) for h, blob in zip(out, blobs, strict=True)]


def digest(hashes: np.ndarray) -> np.ndarray:
    """Chained Bloom filters, a row of 256 bytes each, of distinct features in order of first appearance."""
    _, first = np.unique(hashes, return_index=True)
    h = hashes[np.sort(first)]
    n = -(-len(h) // PER_FILTER)
    bits = np.zeros((n, BITS), dtype=np.uint8)
    row = np.arange(len(h)) // PER_FILTER
    for k in range(PROBES):
        bits[row, ((h >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1)


def text_of(filters: np.ndarray) -> str:
    return f"{len(filters)}:{base64.b64encode(filters.tobytes()).decode()}"


def digest_of(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text.partition(":")[2]), dtype=np.uint8).reshape(-1, BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; 1 for equal digests, 0 if only one is empty."""
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if (len(b), b.tobytes()) < (len(a), a.tobytes()):
        a, b = b, a
    y = np.unpackbits(b, axis=1).astype(np.float32)
    few = FEW * PROBES * 0.9
    own = np.bitwise_count(a).sum(axis=1).astype(np.float64)
    theirs = y.sum(axis=1, dtype=np.float64)
    total = 0.0
    for s in range(0, len(a), 64):
        x = np.unpackbits(a[s : s + 64], axis=1).astype(np.float32)
        common = (x @ y.T).astype(np.float64)
        most = np.minimum(own[s : s + 64, None], theirs[None, :])
        chance = own[s : s + 64, None] * theirs[None, :] / BITS
        floor = chance + NOISE * (most - chance)
        beside = (theirs[None, :] < few) & (theirs.max() >= few) & (own[s : s + 64, None] >= few)
        stands = np.where(beside, most, own[s : s + 64, None])
        total += float((np.clip((common - floor) / np.maximum(most - floor, 1e-9), 0, 1) * stands).max(axis=1).sum())
    return min(1.0, total / float(own.sum()))


FIELDS = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, after: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def compared(group: list):
    """The rows of FIELDS for (id, text, next text)."""
    import pyarrow as pa

    texts = [t for _, t, _ in group]
    edits = [edited(t, a) for _, t, a in group]
    after = [a for _, _, a in group]
    blobs = {t: None for t in [*texts, *edits, *after]}
    made = [digest(h) for h in features([encode(t) for t in blobs])]
    of = dict(zip(blobs, made, strict=True))
    columns = [[i for i, _, _ in group], [len(t) for t in texts], [sha256(encode(e)) for e in edits], [text_of(of[t]) for t in texts], [text_of(of[e]) for e in edits],
               [likeness(of[t], of[e]) for t, e in zip(texts, edits, strict=True)], [likeness(of[t], of[a]) for t, a in zip(texts, after, strict=True)]]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in FIELDS.split(", ")])


def groups(rows):
    """Runs of (id, text, next text) of about 1 MB at most."""
    group, size = [], 0
    for r in rows:
        group.append(r)
        size += len(r[1]) + len(r[2])
        if size > 1 << 20 or len(group) >= 256:
            yield group
            group, size = [], 0
    if group:
        yield group


def in_ranges(docs: DataFrame, id_col: str, text_col: str, ranges: int | None) -> DataFrame:
    """FIELDS of every row but the last of its range, with role 0; and each range's first row (role 1) and last row (role 2) as part, id, body.

    Rows are range-sorted by descending id (null last; equal ids by a hash of the text); equal rows spread over ranges, too.
    """
    import pyarrow as pa

    rows = docs.select(col(id_col).cast("bigint").alias("id"), F.coalesce(col(text_col), F.lit("")).alias("body"))
    order = [F.col("id").desc_nulls_last(), F.col("code").desc(), F.col("copy")]
    x = rows.withColumns({"code": F.xxhash64("body"), "copy": F.monotonically_increasing_id()})
    x = x.repartitionByRange(ranges or max(1, 2 * rows.rdd.getNumPartitions()), *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "id", "body")
    width = len(FIELDS.split(", "))

    def edge(part: int, role: int, i: int | None, body: str) -> pa.RecordBatch:
        values = [i, *[None] * (width - 1), part, role, body]
        return pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(values, kinds(), strict=True)], names=names)

    def kinds() -> list:
        return [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int32(), pa.string()]

    names = [*(f.split()[0] for f in FIELDS.split(", ")), "part", "role", "body"]

    def run(batches):
        last = None
        edges: list = []

        def pairs():
            nonlocal last
            for b in sliced(batches):
                for part, i, body in zip(*(b.column(c).to_pylist() for c in ("part", "id", "body")), strict=True):
                    if last is None:
                        edges.append(edge(part, 1, i, body))
                    else:
                        yield last[1], last[2], body
                    last = part, i, body

        for group in groups(pairs()):
            done, n = compared(group), len(group)
            yield pa.RecordBatch.from_arrays([*done.columns, pa.nulls(n, pa.int64()), pa.array([0] * n, type=pa.int32()), pa.nulls(n, pa.string())], names=names)
        if last:
            edges.append(edge(last[0], 2, last[1], last[2]))
        yield from edges

    ready(docs)
    return x.mapInArrow(run, f"{FIELDS}, part bigint, role int, body string")


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", ranges: int | None = None) -> DataFrame:
    """Per row: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A text's last third (of its code points, rounded down) is replaced by the first as many of the next text's in the
    edited text.  Null texts are empty; the digests of empty texts are empty, and like each other only.  Texts without a
    window of 1 bit of entropy (runs of one character) are like equal texts only.  A single row is its own next.  Ids are integers; with equal ids rows go by a hash of their text; other columns are not read.

    One range sort deals the texts; the last row of a range meets the first one of the next range afterwards, in a join
    of one row per range.
    """
    x = written(in_ranges(docs, id_col, text_col, ranges), "fingerprints")
    fields = [f.split()[0] for f in FIELDS.split(", ")]
    starts = x.filter("role = 1").select("part", F.col("body").alias("after"))
    parts = starts.select("part", F.lead("part").over(W.orderBy("part")).alias("next"))  # one narrow row per range
    follow = parts.withColumn("next", F.coalesce("next", F.min("part").over(W.partitionBy())))
    ends = x.filter("role = 2").select("part", "id", "body").join(follow, "part").drop("part")
    ends = ends.join(starts.withColumnRenamed("part", "next"), "next").select("id", "body", "after")

    def run(batches):
        for b in sliced(batches):
            for group in groups(zip(*(b.column(c).to_pylist() for c in ("id", "body", "after")), strict=True)):
                yield compared(group)

    return x.filter("role = 0").select(*fields).unionByName(ends.mapInArrow(run, FIELDS)).withColumnRenamed("id", id_col)
