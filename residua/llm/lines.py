"""Line dedup: documents probe a sharded minimal perfect hash of repeated lines.

A line's identity is the 128-bit hash of its key.  One aggregation counts the documents of each key; those that more
than one document has (or, if they are too many to broadcast, enough documents) are dealt to shards by hash, of about
``SHARD_KEYS`` keys.  A shard is a minimal perfect hash (levels of bit
arrays; a key that is alone at its bit in a level is placed there, the others go on to the next level) whose ranks
index an array of 64-bit fingerprints and one of 32-bit counts.  Documents probe these arrays: a line goes if its
fingerprint is there and its count reaches the threshold.  No line is joined with a line.

Up to ``broadcast_bytes`` the arrays go to all executors.  Beyond that the lines' hashes are dealt to the shards,
each shard as often as its share of the probes asks for, and the hits return to the texts by the texts' hashes.
Both ways give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cut, fresh, join_hot
from .texts import append, by_batch, encode, sha256

SHARD_KEYS = 1_000_000
#: Line hashes that one task probes with in the sharded way.
TASK_PROBES = 2_000_000
BROADCAST_BYTES = 32 << 20
LEVELS, GAMMA = 64, 1.6
#: Of a fingerprint, a count and their part of the bits.
KEY_BYTES = 12.5
SHARD_SCHEMA = "shard bigint, keys bigint, levels array<bigint>, bits binary, fingerprints binary, counts binary"


def _mixed(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """A hash of both halves that differs by level."""
    with np.errstate(over="ignore"):
        x = a ^ (b * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(level) * np.uint64(0xD1B54A32D192ED03)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class Shard:
    """A minimal perfect hash of keys (a, b), two uint64 each, with a fingerprint and a count per key."""

    def __init__(self, levels: list[int], bits: np.ndarray, fingerprints: np.ndarray, counts: np.ndarray):
        self.levels, self.bits, self.fingerprints, self.counts = levels, bits, fingerprints, counts
        self.ranks = np.r_[0, np.cumsum(np.bitwise_count(bits), dtype=np.int64)]

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> Shard:
        """From distinct keys in any order."""
        levels, words, rest = [], [], np.arange(len(a))
        while len(rest):
            if len(levels) == LEVELS:
                raise ValueError("keys are not distinct")
            m = (int(GAMMA * len(rest)) // 64 + 1) * 64
            at = (_mixed(a[rest], b[rest], len(levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            levels.append(m)
            rest = rest[~alone[at]]
        out = cls(levels, np.concatenate(words) if words else np.empty(0, np.uint64), b, counts)
        place = out.place(a, b)
        order = np.empty(len(a), dtype=np.int64)
        order[place] = np.arange(len(a))
        out.fingerprints, out.counts = b[order], counts[order]
        return out

    def place(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The index of each key; -1 for those whose bits are all unset, some index for other strange keys."""
        out, rest, base = np.full(len(a), -1, dtype=np.int64), np.arange(len(a)), 0
        for level, m in enumerate(self.levels):
            if not len(rest):
                break
            at = base + (_mixed(a[rest], b[rest], level) % np.uint64(m)).astype(np.int64)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[rest[hit]] = (self.ranks[at >> 6] + below)[hit]
            rest, base = rest[~hit], base + m
        return out

    def count(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The count of each key, 0 for those that are not in the shard."""
        if not len(self.fingerprints) or not len(a):
            return np.zeros(len(a), dtype=np.int64)
        at = self.place(a, b)
        return np.where((at >= 0) & (self.fingerprints[at] == b), self.counts[at], 0)

    def row(self, shard: int) -> tuple:
        return shard, len(self.counts), self.levels, self.bits.tobytes(), self.fingerprints.tobytes(), np.minimum(self.counts, np.iinfo(np.int32).max).astype(np.int32).tobytes()

    @classmethod
    def of(cls, row) -> Shard:
        return cls(list(row["levels"]), np.frombuffer(row["bits"], np.uint64), np.frombuffer(row["fingerprints"], np.uint64), np.frombuffer(row["counts"], np.int32))


@dataclass
class LineIndex:
    """The shards as a table, how many there are, and their size."""

    shards: DataFrame
    n: int
    bytes: int


def shard_of(a: np.ndarray, n: int) -> np.ndarray:
    return ((a >> np.uint64(24)) % np.uint64(n)).astype(np.int64)


def hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) for k in keys), dtype=np.uint64)
    return both[::2], both[1::2]


def keyed(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and their keys."""
    lines = encode(text).split(b"\n")
    return lines, [x.strip(b" \t\n\v\f\r").lower() for x in lines]


def counted(docs: DataFrame, text_col: str, min_chars: int, id_col: str | None = None) -> DataFrame:
    """a, b, n: each key's hash and the number of documents with it.

    Rows are documents; with ``id_col`` rows of one id are one document, rows without an id are documents of their own.
    """

    def keys_of(text: str | None) -> list[bytes]:
        return [k for k in set(keyed(text)[1]) if (len(k) if min_chars <= 1 else len(k.decode("utf-8", "replace"))) >= min_chars]

    def work(x: pd.DataFrame) -> pd.DataFrame:
        a, b = hashes([k for t in x["text"] for k in keys_of(t)])
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    def apart(x: pd.DataFrame) -> pd.DataFrame:
        keys = [keys_of(t) for t in x["text"]]
        a, b = hashes([k for own in keys for k in own])
        return pd.DataFrame({"id": x["id"].repeat([len(own) for own in keys]), "a": a.view(np.int64), "b": b.view(np.int64)})

    rows = docs.select(*([col(id_col).alias("id")] if id_col else []), col(text_col).alias("text"))
    shared = None
    if id_col:
        shared = cut(rows.filter("id is not null").groupBy("id").count().filter("count > 1").select("id"))
        shared = shared if shared.take(1) else None
    single = rows if shared is None else rows.join(shared, "id", "left_anti")
    out = by_batch(single, ["text"], work, "a bigint, b bigint")
    if shared is not None:
        kind = docs.schema[id_col].dataType.simpleString()
        out = out.unionByName(by_batch(rows.join(shared, "id", "left_semi"), ["id", "text"], apart, f"id {kind}, a bigint, b bigint").distinct().drop("id"))
    return out.groupBy("a", "b").agg(F.count("*").alias("n"))


def build_index(docs: DataFrame, text_col="text", min_docs: int = 10, min_chars: int = 1, shard_keys: int = SHARD_KEYS, id_col: str | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> LineIndex:
    """Of the keys that more than one document has, or of all if one is enough; of those in ``min_docs`` documents where more would be too many to broadcast."""
    repeated = cut(counted(docs, text_col, max(1, min_chars), id_col).filter(F.col("n") >= min(2, min_docs)))
    keys = repeated.count()
    if keys * KEY_BYTES > broadcast_bytes:
        repeated = repeated.filter(F.col("n") >= min_docs)
        keys = repeated.count()
    n = max(1, -(-keys // shard_keys))

    def build(x: pd.DataFrame) -> pd.DataFrame:
        a, b = (x[c].to_numpy(np.int64).view(np.uint64) for c in "ab")
        return pd.DataFrame([Shard.build(a, b, x["n"].to_numpy(np.int64)).row(int(x["shard"].iloc[0]))], columns=["shard", "keys", "levels", "bits", "fingerprints", "counts"])

    shard = F.shiftrightunsigned("a", 24) % n
    shards = cut(repeated.withColumn("shard", shard).groupBy("shard").applyInPandas(build, SHARD_SCHEMA))
    size = shards.agg(F.coalesce(F.sum(F.length("bits") + F.length("fingerprints") + F.length("counts")), F.lit(0)).alias("s")).first()["s"]
    return LineIndex(shards, n, size)


def _kept(lines: list[bytes], drop: list[bool] | np.ndarray, text: str | None, texts: bool) -> tuple:
    n = int(np.count_nonzero(drop))
    kept = b"\n".join(x for x, d in zip(lines, drop, strict=True) if not d) if n else b"\n".join(lines)
    return len(lines), n, sha256(kept), *((None if text is None else kept.decode("utf-8", "surrogatepass"),) if texts else ())


def dedup_lines(docs: DataFrame, text_col="text", min_docs: int = 10, min_chars: int = 1, broadcast_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS, texts: bool = True, id_col: str | None = None) -> tuple[DataFrame, dict]:
    r"""``docs`` with n_lines, n_dropped, kept_sha256 and, with ``texts``, kept_text; and the names they got, which never clash.

    A line's key is the line without white space ``[\x20\x09-\x0D]`` at its ends and with A-Z lower-cased.  Lines whose
    key has ``min_chars`` code points (at least 1) and is in ``min_docs`` documents go, wherever they are; the others
    stay, joined by \n.  A null or empty text is one empty line, which stays; kept_text of null is null.  Repeated rows
    count as documents of their own, but with ``id_col`` those of one id as one document; rows without an id always do.
    """
    index = build_index(docs, text_col, min_docs, min_chars, shard_keys, id_col, broadcast_bytes)
    fields = [("n_lines", "bigint"), ("n_dropped", "bigint"), ("kept_sha256", "string"), *([("kept_text", "string")] if texts else [])]
    names = dict(zip((n for n, _ in fields), fresh(docs, *(n for n, _ in fields)), strict=True))
    fields = [(names[n], kind) for n, kind in fields]
    if index.bytes <= broadcast_bytes:
        return _probed(docs, index, text_col, min_docs, fields, texts), names
    return _sharded(docs, index, text_col, min_docs, max(1, min_chars), fields, texts), names


def _probed(docs: DataFrame, index: LineIndex, text_col: str, min_docs: int, fields: list, texts: bool) -> DataFrame:
    """Documents probe the broadcast arrays."""
    shared, n = docs.sparkSession.sparkContext.broadcast([r.asDict() for r in index.shards.collect()]), index.n
    opened: dict[int, Shard] = {}
    least = max(1, min_docs)  # a count of 0 says that the key isn't there

    def work(values: list) -> list[list]:
        if not opened:
            opened.update({r["shard"]: Shard.of(r) for r in shared.value})
        split = [keyed(t) for t in values]
        a, b = hashes([k for _, keys in split for k in keys])
        drop, at = np.zeros(len(a), dtype=bool), shard_of(a, n)
        for s in np.unique(at):
            if int(s) in opened:
                mine = at == s
                drop[mine] = opened[int(s)].count(a[mine], b[mine]) >= least
        ends = np.cumsum([0, *(len(x) for x, _ in split)])
        out = [_kept(x, drop[ends[k] : ends[k + 1]], t, texts) for k, ((x, _), t) in enumerate(zip(split, values, strict=True))]
        return [list(c) for c in zip(*out, strict=True)]

    return append(docs, [text_col], work, fields)


def _sharded(docs: DataFrame, index: LineIndex, text_col: str, min_docs: int, min_chars: int, fields: list, texts: bool) -> DataFrame:
    """The hashes of each text's lines go to the shards; equal texts have equal hits, so these return by the text's hash."""
    n, least = index.n, max(1, min_docs)

    def lines_of(x: pd.DataFrame) -> pd.DataFrame:
        seen = {encode(t): t for t in x["text"]}
        own, keys = [], []
        for k, t in enumerate(seen):
            found = [key for key in set(keyed(seen[t])[1]) if len(key.decode("utf-8", "replace")) >= min_chars]
            own += [k] * len(found)
            keys += found
        a, b = hashes(keys)
        ta, tb = hashes(list(seen))
        return pd.DataFrame({"t": ta.view(np.int64)[own], "u": tb.view(np.int64)[own], "a": a.view(np.int64), "b": b.view(np.int64)})

    probes = by_batch(docs.select(col(text_col).alias("text")), ["text"], lines_of, "t bigint, u bigint, a bigint, b bigint")
    probes = probes.withColumn("shard", F.shiftrightunsigned("a", 24) % n)
    load = probes.groupBy("shard").count()
    copies = cut(load.select("shard", F.ceil(F.col("count") / TASK_PROBES).cast("int").alias("copies")))
    probes = probes.join(copies, "shard").withColumn("copy", F.pmod(F.col("t"), F.col("copies")).cast("int"))
    arrays = index.shards.join(copies, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))

    def probe(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return x[["t", "u", "a", "b"]].iloc[:0]
        a, b = (x[c].to_numpy(np.int64).view(np.uint64) for c in "ab")
        return x.loc[Shard.of(y.iloc[0]).count(a, b) >= least, ["t", "u", "a", "b"]]

    hits = probes.groupBy("shard", "copy").cogroup(arrays.groupBy("shard", "copy")).applyInPandas(probe, "t bigint, u bigint, a bigint, b bigint")
    hits = cut(hits.dropDuplicates().groupBy("t", "u").agg(F.collect_list(F.struct("a", "b")).alias("hits")))
    key, found, weight = fresh(docs, "text_key", "hits", "texts")
    keyed_docs = append(docs, [text_col], lambda v: [[xxhash.xxh3_128_digest(encode(t)).hex() for t in v]], [(key, "string")])
    counts = keyed_docs.groupBy(col(key)).agg(F.count("*").alias(weight))
    digest = _digest_column(hits).withColumnsRenamed({"hits": found, "key": key})
    right = counts.join(digest, key, "left")
    joined = join_hot(keyed_docs, cut(right), key, weight)

    def work(values: list, drops: list) -> list[list]:
        out = []
        for t, d in zip(values, drops, strict=True):
            lines, keys = keyed(t)
            gone = {(x["a"], x["b"]) for x in d or ()}
            a, b = hashes(keys)
            out.append(_kept(lines, [p in gone for p in zip(a.view(np.int64).tolist(), b.view(np.int64).tolist(), strict=True)], t, texts))
        return [list(c) for c in zip(*out, strict=True)]

    return append(joined, [text_col, found], work, fields, drop=(key, found, weight))


def _digest_column(hits: DataFrame) -> DataFrame:
    """key, hits: the text's hash as the hexadecimal text of its digest."""

    def work(t: list, u: list) -> list[list]:
        return [[np.array([x, y], dtype=np.int64).tobytes().hex() for x, y in zip(t, u, strict=True)]]

    return append(hits, ["t", "u"], work, [("key", "string")], drop=("t", "u"))
