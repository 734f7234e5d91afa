"""MinHash near-dedup: universal hash minima, banding, signature verification, exact confirmation, star components.

Nodes are different shingle sets, named by a 64-bit hash, so copies cost nothing more.  A node's signature is the minima
of many universal hash functions over its shingles; ``banding`` picks so many rows and bands that a pair at the
threshold shares a band but for one in a million.  Nodes that share a band share a bucket.

Round 1 compares every node with one node: that of the centers of its buckets with the likest signature.  Only
connectedness counts, so a bucket whose nodes are by now in one component is settled.  Round 2 takes the others whole:
nodes of the bucket's main component stay, in blocks; those of other components are guests of all blocks where a
signature allows a link with one of their own, so every pair of nodes in different components is looked at.  Links are
confirmed on the full sets: a block's sets form an inverted index, and guests come one by one.  So a group of n near
copies sends about n sets, and of nodes that are linked with none one set per block, never a pair of texts each.

A bucket with more than WIDE nodes outside its main component (texts with a common passage, under the threshold) is
wide: its nodes meet by their rarest shingles instead.  In any one order of all shingles, two linked sets have a shingle
in common that is among the first n - ceil(t * n) + 1 of the larger one and, since a link needs 2 * t / (1 + t) of the
smaller one, among the first n - ceil(2 * t * n / (1 + t)) + 1 of that (``prefixes``).  With frequent shingles last, a
passage of unlinked texts is not in the second prefix, so such texts don't meet.  Nothing is lost by this, whatever the
order; so frequencies may be counted in CELLS cells of hashes, of fixed size.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, discard, fresh, join_hot, written
from .texts import LOWER, append, encode, sliced, slices

MOST_HASHES, MISS = 192, 1e-6
#: Signature bytes agree by chance in 1 of 256; the sieve lets pass what is this much under the threshold.
MARGIN = 0.16
BLOCK, SLICE_ROWS = 512, 4096
#: Nodes outside the main component that a bucket compares with all of its nodes; beyond, they meet by rare shingles.
WIDE = 64
#: Cells in which frequencies of shingles are counted.
CELLS = 1 << 20
#: Edges of a partition in the rounds of the stars.
EDGES = 500_000
#: How many nodes of a group the buckets of the group have as centers, about.
CENTERS = 6
#: Texts of pairs are picked by a broadcast of at most so many rows of 40 bytes, by a shuffled join beyond.
BROADCAST_ROWS = 400_000
NO_ID = -(2**63)
GOLD = np.uint64(0x9E3779B97F4A7C15)


def cut(df: DataFrame) -> DataFrame:
    """A table in the shared folder: its small files are read together, so what follows has few tasks where there is little."""
    return written(df, "links")


def banding(threshold: float, most: int = MOST_HASHES, miss: float = MISS) -> tuple[int, int]:
    """Rows a band and bands: most rows, so that a pair at the threshold is missed with at most this probability."""
    for rows in range(12, 0, -1):
        bands = ceil(log(miss) / log(1 - threshold**rows)) if threshold < 1 else 1
        if rows * bands <= most:
            return rows, bands
    return 1, most


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    BYTES = mix(np.arange(1, 257, dtype=np.uint64) * GOLD)
BREAK = np.zeros(256, dtype=bool)
BREAK[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, A-Z lower-cased, of all texts, and where each text's words begin; a last entry is the end."""
    x = np.frombuffer(b"\n".join([*blobs, b""]), dtype=np.uint8)
    word = ~BREAK[x]
    starts = np.flatnonzero(word & ~np.r_[False, word[:-1]])
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(blobs) + 1, dtype=np.int64)
    place = np.arange(len(x)) - np.repeat(starts, np.diff(np.r_[starts, len(x)])) if starts[0] == 0 else np.r_[np.zeros(starts[0], dtype=np.int64), np.arange(starts[0], len(x)) - np.repeat(starts, np.diff(np.r_[starts, len(x)]))]
    with np.errstate(over="ignore"):
        terms = np.where(word, BYTES[LOWER[x]] * (mix((place + 1).astype(np.uint64) * GOLD) | np.uint64(1)), np.uint64(0))
        h = mix(np.add.reduceat(terms, starts))
    ends = np.cumsum([0, *(len(b) + 1 for b in blobs)])
    return h, np.searchsorted(starts, ends)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles of ``size`` words; fewer words are one shingle, none are none."""
    out = []
    blobs = [encode(t) for t in texts]
    for a, b in slices(blobs):
        h, first = word_hashes(blobs[a:b])
        with np.errstate(over="ignore"):
            code = np.zeros(max(0, len(h) - size + 1), dtype=np.uint64)
            for k in range(size):
                code = (code + h[k : k + len(code)]) * GOLD
                code ^= code >> np.uint64(29)
            for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                if e - s >= size:
                    out.append(np.unique(code[s : e - size + 1]))
                elif e > s:
                    one = np.full(1, e - s, dtype=np.uint64)
                    for w in h[s:e]:
                        one = mix((one + w) * GOLD)
                    out.append(one)
                else:
                    out.append(np.empty(0, np.uint64))
    return out


def node_of(shingles: np.ndarray) -> int:
    """A 64-bit name of a set."""
    import xxhash

    return int(np.frombuffer(xxhash.xxh3_64_digest(shingles.tobytes()), dtype=">i8")[0])


class Hasher:
    """Minima of rows * bands universal hash functions a * x + b mod 2^64, a odd, with the top 32 bits kept."""

    def __init__(self, rows: int, bands: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        n = rows * bands
        self.rows, self.bands = rows, bands
        self.a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, n, dtype=np.uint64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), np.iinfo(np.uint64).max, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(0, len(shingles), 64):
                v = np.multiply.outer(shingles[k : k + 64], self.a)
                v += self.b
                np.minimum(out, v.min(axis=0), out=out)
        return (out >> np.uint64(32)).astype(np.uint32)

    def bands_of(self, minima: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = np.arange(1, self.bands + 1, dtype=np.uint64) * GOLD
            for v in minima.reshape(self.bands, self.rows).T.astype(np.uint64):
                h = mix((h ^ v) * GOLD)
        return h.view(np.int64)


def signed(docs: DataFrame, size: int, hasher: Hasher) -> DataFrame:
    """id, code, n, node, bands, signature of the rows of ``docs`` (id, body, code); the last three null for empty sets."""

    def work(texts: list) -> list[list]:
        out, known = [], {}
        for s in shingle_sets(texts, size):
            if not len(s):
                out.append((0, None, None, None))
                continue
            node = node_of(s)
            if node not in known:
                m = hasher.minima(s)
                known[node] = len(s), node, hasher.bands_of(m).tolist(), (m & 0xFF).astype(np.uint8).tobytes()
            out.append(known[node])
        return [list(c) for c in zip(*out, strict=True)]

    return append(docs, ["body"], work, [("n", "bigint"), ("node", "bigint"), ("bands", "array<bigint>"), ("signature", "binary")], drop=("body",))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node that has an edge u, v: alternating large-star and small-star."""

    def stars(e: DataFrame, key_side: DataFrame, total: int) -> DataFrame:
        least = key_side.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("w"))
        return join_hot(e, least, "u", "w", total)

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("u", "v"), 16)).alias("s")).first()
        return r["n"], r["s"]

    table = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last, now = None, state(table)
    parts = 1 + now[0] // EDGES  # there are never more than twice the edges, so few files each round
    while now != last:
        e = table.coalesce(parts)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stars(both.filter("v > u"), both, 2 * now[0]).select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = cut(large.coalesce(parts))
        small = stars(large, large, now[0])
        new = cut(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct().coalesce(parts))
        discard(table, large)
        table, last, now = new, now, state(new)
    e = table.coalesce(parts)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


class Links:
    """Confirms links of nodes on their whole sets: 100 * common >= percent * union."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, size: int, percent: int, repeated: bool):
        """``repeated``: some rows have the same id, or none, and the same text."""
        self.docs, self.nodes, self.size, self.percent, self.repeated = docs, nodes, size, percent, repeated

    def nearest(self, pairs: DataFrame) -> DataFrame:
        """u, v: for each v of ``pairs`` the u with the likest signature, if sizes and signatures allow a link."""
        n = self.nodes
        weight = pairs.groupBy("u").agg(F.count("*").alias("w"))
        left = pairs.join(n.select(F.col("node").alias("v"), F.col("n").alias("n_v"), F.col("signature").alias("s_v")), "v")
        right = weight.join(n.select(F.col("node").alias("u"), F.col("n").alias("n_u"), F.col("signature").alias("s_u")), "u")
        both = join_hot(left, right, "u", "w").filter(100 * F.least("n_u", "n_v") >= self.percent * F.greatest("n_u", "n_v"))

        def work(a: list, b: list) -> list[list]:
            return [[int(np.count_nonzero(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8))) for x, y in zip(a, b, strict=True)]]

        equal = append(both.select("u", "v", "s_u", "s_v", F.length("s_u").alias("all")), ["s_u", "s_v"], work, [("equal", "int")], drop=("s_u", "s_v"))
        equal = equal.filter(F.col("equal") >= F.col("all") * (self.percent / 100 - MARGIN))
        return equal.groupBy("v").agg(F.max_by("u", F.struct("equal", "u")).alias("u")).select("u", "v")

    def stars(self, pairs: DataFrame) -> DataFrame:
        """The linked ones among the pairs u, v: each u meets its partners in slices."""
        sides = pairs.groupBy("u").agg(F.count("*").alias("w")).withColumn("slices", F.ceil(F.col("w") / BLOCK).cast("int"))
        place = lambda u, k: F.concat(F.lit("star:"), u.cast("string"), F.lit(":"), k.cast("string")).alias("place")
        guests = join_hot(pairs, sides, "u", "w").select(F.col("v").alias("node"), place(F.col("u"), F.pmod(F.hash("v"), F.col("slices"))), F.lit(1).alias("role"))
        hosts = sides.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(F.col("u").alias("node"), place(F.col("u"), F.col("slice")), F.lit(0).alias("role"))
        return self.confirmed(hosts.unionByName(guests))

    def with_sets(self, wanted: DataFrame) -> DataFrame:
        """``wanted``, which has a column node, with the nodes' sets in a column shingles."""
        key, own = F.coalesce("id", F.lit(NO_ID)).alias("key"), wanted.columns
        wanted = cut(wanted.join(self.nodes.select("node", F.col("row.id").alias("id"), F.col("row.code").alias("code")), "node").select(*own, key, "code"))
        side = F.broadcast if wanted.count() <= BROADCAST_ROWS else lambda x: x
        rows = self.docs.select(key, "code", "body")
        if self.repeated:  # one of equal rows stands for its node
            rows = rows.join(side(wanted.select("key", "code").distinct()), ["key", "code"], "left_semi").groupBy("key", "code").agg(F.first("body").alias("body"))
        rows = rows.join(side(wanted), ["key", "code"]).drop("key", "code")
        size = self.size

        def sets(texts: list, nodes: list) -> list[list]:
            known = dict(zip(own := list(dict.fromkeys(texts)), shingle_sets(own, size), strict=True))
            names = {t: node_of(s) for t, s in known.items()}
            return [[known[t].tobytes() if names[t] == n else None for t, n in zip(texts, nodes, strict=True)]]  # different texts could have one code

        return append(rows, ["body", "node"], sets, [("shingles", "binary")], drop=("body",)).filter("shingles is not null")

    def prefixes(self, wide: DataFrame) -> DataFrame:
        """shingle, node, component, short: the rarest shingles of the nodes of ``wide`` (node, component), without those of one node only.

        ``short``: also in the prefix that counts where the node is the smaller one of two.  The cells' counts are all
        that reaches the driver, at most CELLS numbers.
        """
        sets, cells, percent = cut(self.with_sets(wide)), CELLS, self.percent

        def tally(batches):
            import pyarrow as pa

            n = np.zeros(cells, dtype=np.int64)
            for b in sliced(batches):
                for data in b.column("shingles").to_pylist():
                    np.add.at(n, np.frombuffer(data, np.uint64) % np.uint64(cells), 1)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["cell", "n"])

        counts = np.zeros(cells, dtype=np.int64)
        found = sets.select("shingles").mapInArrow(tally, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        counts[found["cell"].to_numpy()] = found["n"].to_numpy()
        shared = wide.sparkSession.sparkContext.broadcast(np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32))

        def rarest(batches):
            import pyarrow as pa

            for b in sliced(batches):
                out = [[], [], [], []]
                for node, component, data in zip(*(b.column(k).to_pylist() for k in ("node", "component", "shingles")), strict=True):
                    s = np.frombuffer(data, np.uint64)
                    n, often = len(s), shared.value[s % np.uint64(cells)]
                    first = np.lexsort((s, often))[: n - -(-percent * n // 100) + 1]
                    short = np.arange(len(first)) < n - -(-2 * percent * n // (100 + percent)) + 1
                    use = often[first] > 1
                    k = int(use.sum())
                    for o, v in zip(out, (s[first[use]].view(np.int64), np.full(k, node), np.full(k, component), short[use]), strict=True):
                        o.append(v)
                kinds = (np.int64, np.int64, np.int64, bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, t), *o]).astype(t)) for o, t in zip(out, kinds, strict=True)], names=["shingle", "node", "component", "short"])

        return sets.select("node", "component", "shingles").mapInArrow(rarest, "shingle bigint, node bigint, component bigint, short boolean")

    def confirmed(self, meetings: DataFrame) -> DataFrame:
        """u, v: links that connect what meets at a place, as far as links of its guests (role 1) with its hosts (role 0) do.

        A place holds its hosts' sets, about BLOCK, and gets guests one by one; links within what is already connected
        are left out, so there are fewer than nodes.  Hosts of places named ``main`` are connected beforehand.
        """
        percent = self.percent
        full = self.with_sets(meetings.select("node", "place", "role"))
        dealt = full.repartition("place").sortWithinPartitions("place", "role", "node")

        def meet(batches):
            import pyarrow as pa

            name, place = None, None
            for b in sliced(batches):
                u, v = [], []
                for p, role, node, data in zip(*(b.column(k).to_pylist() for k in ("place", "role", "node", "shingles")), strict=True):
                    if p != name:
                        name, place = p, Place(percent, p.startswith("main:"))
                    if role == 0:
                        place.add(node, np.frombuffer(data, dtype=np.uint64))
                    else:
                        for host in place.links(node, np.frombuffer(data, dtype=np.uint64)):
                            u.append(host)
                            v.append(node)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        return dealt.mapInArrow(meet, "u bigint, v bigint")


class Place:
    """Hosts' sets as an inverted index, and which nodes are connected here."""

    def __init__(self, percent: int, one: bool):
        self.percent, self.one, self.hosts, self.sets, self.parent = percent, one, [], [], {}
        self.keys = None

    def add(self, node: int, shingles: np.ndarray) -> None:
        if node not in self.parent:
            self.hosts.append(node)
            self.sets.append(shingles)
            self.parent[node] = self.hosts[0] if self.one else node

    def root(self, node: int) -> int:
        while self.parent[node] != node:
            self.parent[node] = node = self.parent[self.parent[node]]
        return node

    def links(self, node: int, shingles: np.ndarray) -> list[int]:
        """Hosts that the guest connects with anew; it counts as connected with them from now on."""
        if self.keys is None:
            flat = np.concatenate(self.sets) if self.sets else np.empty(0, np.uint64)
            order = np.argsort(flat, kind="stable")
            owner = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets])
            self.owner = owner[order]
            self.keys, first = np.unique(flat[order], return_index=True)
            self.first = np.r_[first, len(flat)]
            self.sizes = np.array([len(s) for s in self.sets], dtype=np.int64)
            self.sets = []
        if not len(self.keys):
            return []
        at = np.searchsorted(self.keys, shingles)
        at[at == len(self.keys)] = 0
        at = at[self.keys[at] == shingles]
        lens = self.first[at + 1] - self.first[at]
        spots = np.repeat(self.first[at] - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(lens.sum()) if len(at) else np.empty(0, np.int64)
        common = np.bincount(self.owner[spots], minlength=len(self.hosts))
        out = []
        self.parent.setdefault(node, node)
        for k in np.flatnonzero(100 * common >= self.percent * (self.sizes + len(shingles) - common)).tolist():
            a, b = self.root(self.hosts[k]), self.root(node)
            if a != b:
                self.parent[b] = a
                out.append(self.hosts[k])
        return out


def _power(c):
    """The power of two from c on, at least 1."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), c)))).cast("int")


def _rest(members: DataFrame, found: DataFrame, links: Links) -> DataFrame:
    """node, place, role: where the nodes of unsettled buckets meet those of other components.

    Hosts are nodes with a guest whose sizes and signatures allow a link.  Those of a bucket's main component meet
    guests in that component's blocks, the same in all buckets; others in blocks of their bucket's main component.
    """
    sizes = found.groupBy("component").agg(F.count("*").alias("nodes"))
    x = members.select("band", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    by = x.groupBy("band", "component").agg(F.count("*").alias("c"))
    open_ = by.groupBy("band").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("all"), F.count("*").alias("parts")).filter("parts > 1")
    open_ = cut(open_.join(sizes.withColumnRenamed("component", "main"), "main", "left").withColumn("others", F.col("all") - F.col("most")))
    narrow = open_.filter(F.col("others") <= WIDE).select("band", "main", "all", F.ceil(F.col("all") / SLICE_ROWS).cast("int").alias("blocks"), F.lit(1).alias("slices"), _power(F.coalesce("nodes", F.lit(1)) / BLOCK).alias("k0"))
    y = join_hot(x, narrow, "band", "all")
    own = F.col("component") == F.col("main")
    host = F.when(own, F.concat_ws(":", F.lit("main"), "main", "k0", F.pmod(F.hash("node"), F.col("k0")))).otherwise(F.concat_ws(":", F.lit("rest"), "main", "k0", F.pmod(F.hash("node"), F.col("k0"))))
    y = y.withColumns({"place": host, "hosts": F.lit(True), "guest": ~own, "short": F.lit(True)})
    out = _met(y.withColumnRenamed("band", "bucket"), links.nodes, links.percent)
    wide = open_.filter(F.col("others") > WIDE).select("band", "all")
    if wide.take(1):
        wide = cut(join_hot(x, wide, "band", "all").select("node", "component").distinct())
        out = out.unionByName(_by_shingles(wide, links))
    return out


def _by_shingles(wide: DataFrame, links: Links) -> DataFrame:
    """node, place, role: where nodes of ``wide`` (node, component) meet those of other components with a rare shingle in common.

    One of two has to be ``short`` at the shingle, so it has two buckets: all nodes with the short ones as guests, and
    the short ones with all others as guests.  Places are the hosts' own, so a pair meets once whatever it has in common.
    """
    x = cut(links.prefixes(wide))
    by = x.groupBy("shingle", "component").agg(F.count("*").alias("c"), F.count_if("short").alias("s"))
    total = lambda c: F.sum(c).alias(c)
    open_ = by.groupBy("shingle").agg(F.max_by("component", F.struct("c", "component")).alias("main"), total("c"), total("s"), F.max_by("s", F.struct("c", "component")).alias("own_s"), F.max("c").alias("own"), F.count("*").alias("parts"))
    open_ = open_.filter("parts > 1 and s > 0").withColumnsRenamed({"c": "all"})
    short_guests, long_guests = F.col("s") - F.col("own_s"), F.col("all") - F.col("s") - F.col("own") + F.col("own_s")
    pieces = lambda hosts, guests: (F.ceil(hosts / SLICE_ROWS).cast("int"), _power(guests / SLICE_ROWS))
    (b0, s0), (b1, s1) = pieces(F.col("all"), short_guests), pieces(F.col("s"), long_guests)
    open_ = cut(open_.select("shingle", "main", "all", b0.alias("b0"), s0.alias("s0"), b1.alias("b1"), s1.alias("s1"), (short_guests > 0).alias("use0"), (long_guests > 0).alias("use1")))
    x = join_hot(x, open_, "shingle", "all").withColumn("other", F.col("component") != F.col("main"))
    two = F.array(
        F.struct(F.xxhash64("shingle", F.lit(0)).alias("bucket"), F.col("b0").alias("blocks"), F.col("s0").alias("slices"), F.lit(True).alias("hosts"), (F.col("other") & F.col("short")).alias("guest"), F.col("use0").alias("use")),
        F.struct(F.xxhash64("shingle", F.lit(1)).alias("bucket"), F.col("b1").alias("blocks"), F.col("s1").alias("slices"), F.col("short").alias("hosts"), (F.col("other") & ~F.col("short")).alias("guest"), F.col("use1").alias("use")))
    x = x.select("node", "component", "short", F.explode(two).alias("b")).filter("b.use and (b.hosts or b.guest)").select("node", "component", "short", "b.*")
    total = wide.count()
    place = F.concat_ws(":", F.lit("wide"), F.pmod(F.hash("node"), F.lit(1 + total // BLOCK)))
    return _met(x.withColumn("place", place), links.nodes, links.percent, 1 + total // (16 * SLICE_ROWS))


def _met(x: DataFrame, nodes: DataFrame, percent: int, parts: int | None = None) -> DataFrame:
    """node, place, role: the hosts and guests of a bucket that may be linked, of ``x`` (bucket, node, component, place, hosts, guest, short, blocks, slices).

    Hosts are dealt to the bucket's ``blocks``, with a copy for each of its ``slices``; a guest goes to all blocks of
    its slice.  The smaller one of two has to be ``short``.  A place has a part for each slice, or ``parts`` by its guests.
    """
    x = x.join(nodes.select("node", "n", "signature"), "node")
    span = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    keep = ["bucket", "node", "component", "n", "signature", "place", "short"]
    stay = x.filter("hosts").select(*keep, F.pmod(F.hash("node", F.lit(1)), F.col("blocks")).alias("block"), F.explode(span("slices")).alias("slice"), "slices", F.lit(0).alias("role"))
    go = x.filter("guest").select(*keep, F.explode(span("blocks")).alias("block"), F.pmod(F.hash("node", F.lit(2)), F.col("slices")).alias("slice"), "slices", F.lit(1).alias("role"))
    least = percent / 100 - MARGIN

    def meet(rows) -> set[tuple]:
        """Hosts and guests of one bucket, block and slice that may be linked."""
        roles = rows.column("role").to_numpy()
        first, places = int((roles == 0).sum()), rows.column("place").to_pylist()
        if not 0 < first < len(roles):
            return set()
        node, component, n = (rows.column(c).to_numpy() for c in ("node", "component", "n"))
        short = rows.column("short").to_numpy()
        signature = np.frombuffer(b"".join(rows.column("signature").to_pylist()), dtype=np.uint8).reshape(len(roles), -1)
        slice_, out = f":{rows.column('slices')[0]}:{rows.column('slice')[0]}", set()
        for k in range(first, len(roles), 64):
            a, b = n[:first, None], n[None, k : k + 64]
            ok = (component[:first, None] != component[None, k : k + 64]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
            ok &= ((a <= b) & short[:first, None]) | ((b <= a) & short[None, k : k + 64])
            if ok.any():
                i, j = np.nonzero(ok)
                for s in range(0, len(i), 1 << 16):
                    u, v = i[s : s + (1 << 16)], j[s : s + (1 << 16)] + k
                    alike = np.count_nonzero(signature[u] == signature[v], axis=1) >= least * signature.shape[1]
                    for p, q in zip(u[alike].tolist(), v[alike].tolist(), strict=True):
                        place = places[p] + (f":{node[q] % parts}" if parts else slice_)
                        out |= {(int(node[p]), place, 0), (int(node[q]), place, 1)}
        return out

    def run(batches):
        import pyarrow as pa

        keys, held, found = ["bucket", "block", "slice"], [], set()
        for b in batches:
            at = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys])
            cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if held and held[0][0] != tuple(at[:, s].tolist()):
                    found |= meet(pa.Table.from_batches([x for _, x in held]))
                    held = []
                held.append((tuple(at[:, s].tolist()), b.slice(s, e - s)))
            yield answer(pa, found)
            found = set()
        if held:
            yield answer(pa, meet(pa.Table.from_batches([x for _, x in held])))

    def answer(pa, rows: set[tuple]):
        columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32()), strict=True)], names=["node", "place", "role"])

    dealt = stay.unionByName(go).repartition("bucket", "block", "slice").sortWithinPartitions("bucket", "block", "slice", "role")
    return dealt.mapInArrow(run, "node bigint, place string, role int").distinct()


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    r"""id_col, n_shingles, component_id, kept of every row of ``docs``.

    Words are runs of other than ``[\x20\x09-\x0D]``, A-Z lower-cased; a text's set is its distinct shingles of
    ``shingle_words`` words, all its words as one if it has fewer, and empty without any.  Rows are linked if their sets
    have 100 * common >= percent * union; empty sets are linked with nothing and null texts are empty.  component_id
    is the smallest id of the rows reachable by links; kept says whether it is the row's own.  Rows with one id and
    different texts are classed by their texts.  A null id is linked like others but never the smallest; where no row
    of a component has an id, component_id is null and all its rows are kept.
    """
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("body"))
    return _classed(rows, shingle_words, percent).withColumnRenamed("id", id_col)


def _classed(docs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """id, n_shingles, component_id, kept of the rows of ``docs`` (id, body and other columns, which come last)."""
    more = [c for c in docs.columns if c not in ("id", "body")]
    docs = docs.withColumn("code", F.xxhash64("body"))
    rows, bands = banding(percent / 100)
    every = written(signed(docs, shingle_words, Hasher(rows, bands)), "signed")
    repeated = bool(every.filter("n > 0").groupBy("id", "code").count().filter("count > 1").take(1))
    row = F.max(F.struct("id", "code")).alias("row")  # one of the rows with the node's set
    nodes = written(every.filter("n > 0").groupBy("node").agg(F.min("id").alias("rep"), row, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature")), "nodes")
    spread = nodes.select("node", F.explode("bands").alias("band"))
    pick = F.struct(F.xxhash64("node", F.pmod("band", F.lit(CENTERS))).alias("h"), "node")
    buckets = spread.groupBy("band").agg(F.min(pick).alias("center"), F.count("*").alias("c")).filter("c > 1").select("band", F.col("center.node").alias("center"), "c")
    members = written(join_hot(spread, cut(buckets), "band", "c").select("band", "node", "center"), "members")
    links = Links(docs, nodes, shingle_words, percent, repeated)
    near = links.nearest(members.filter("node <> center").select(F.col("center").alias("u"), F.col("node").alias("v")).distinct())
    found = cut(components(links.stars(cut(near))))
    rest = cut(links.confirmed(_rest(members, found, links)))
    stars = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
    found = components(stars.unionByName(rest)) if rest.take(1) else found
    discard(members)
    named = cut(nodes.select("node", "rep", "copies").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("w"))
    named = join_hot(named, least, "component", "w").select("node", "copies", "component_id")
    out = join_hot(every.filter("n > 0").select("id", "n", "node", *more), named, "node", "copies").select("id", "n", "component_id", *more)
    out = out.unionByName(every.filter("n = 0").select("id", "n", F.col("id").alias("component_id"), *more))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), *more)


def deduplicated(docs: DataFrame, id_col="doc_id", text_col="text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with its columns, that near_duplicates keeps.

    Rows that repeat a kept id and its text all stay; of rows of one id with different texts those go that aren't kept,
    so of each group a document stays.  Rows without an id, which can't be told apart, stay.
    """
    key, code = fresh(docs, "kept_id", "kept_text")
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("body"), F.xxhash64(col(text_col)).alias("code"))  # of the text, as in _classed
    gone = _classed(rows, shingle_words, percent).filter("not kept").select(F.col("id").alias(key), F.col("code").alias(code)).distinct()
    return docs.join(gone, (col(id_col) == F.col(key)) & (F.xxhash64(col(text_col)) == F.col(code)), "left_anti")
