"""Which native contacts are formed in which frames, and the per-frame and per-cluster counts of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import distance, is_formed, once
from .blocks import met

#: Contact maps up to this size are broadcast to the frames; larger ones meet them block by block.
BROADCAST_CONTACTS = 50_000


def pack(coords: DataFrame) -> DataFrame:
    """Long coordinates (traj_id, frame, residue, x, y, z) as one row per frame; residues are distinct in a frame."""
    point = F.struct("residue", F.struct("x", "y", "z").alias("p"))
    return coords.groupBy("traj_id", "frame").agg(F.map_from_entries(F.collect_list(point)).alias("coords"))


def unpack(frames: DataFrame) -> DataFrame:
    return frames.select("traj_id", "frame", F.explode("coords").alias("residue", "p")).select("traj_id", "frame", "residue", "p.x", "p.y", "p.z")


def is_small(contacts: DataFrame, most: int = BROADCAST_CONTACTS) -> bool:
    return contacts.select("cluster").limit(most + 1).count() <= most


def evaluated(frames: DataFrame, contacts: DataFrame, cutoff: float = 1.2, broadcast_contacts: int = BROADCAST_CONTACTS) -> DataFrame:
    """traj_id, frame, ord, i, j, cluster, formed: every contact in every frame; one row with null contact where there are none.

    A contact with an absent residue isn't formed.  The contact side is broadcast after a look at its size.  Of larger
    maps this is frames times contacts rows; ``analyzed`` has the tables made of them without that.
    """
    c = contacts.select("ord", "i", "j", "r", "cluster")
    if is_small(c, broadcast_contacts):
        low, high = F.array_min(F.map_keys("coords")), F.array_max(F.map_keys("coords"))
        x = once(frames, low=low, places=F.transform(F.sequence(low, high), lambda r: F.try_element_at("coords", r)))  # by residue, so that contacts needn't search
        x = x.select("traj_id", "frame", "low", "places").join(F.broadcast(c), F.lit(True), "left")
        x = x.withColumns({"a": F.get("places", F.col("i") - F.col("low")), "b": F.get("places", F.col("j") - F.col("low"))})
        d = distance(F.col("a"), F.col("b"))
        return x.select("traj_id", "frame", "ord", "i", "j", "cluster", is_formed(d, F.col("r"), cutoff).alias("formed"))
    return met(frames, c, cutoff, every=True)


def analyzed(frames: DataFrame, contacts: DataFrame, cutoff: float = 1.2, broadcast_contacts: int = BROADCAST_CONTACTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """frame_results, fill and frame_q of the frames.

    A map too large to broadcast is never multiplied with the frames: formed contacts are counted per frame and cluster,
    and the frames get the clusters' sizes, one array for all.
    """
    if is_small(contacts, broadcast_contacts):
        e = evaluated(frames, contacts, cutoff, broadcast_contacts)
        return frame_by_frame(frames, contacts, cutoff), fill(e), frame_q(e)
    hits = met(frames, contacts, cutoff)
    own = frames.select("traj_id", "frame")
    sizes = cluster_sizes(contacts).agg(F.collect_list(F.struct("cluster", "size")).alias("sizes"))  # one row
    every = own.join(F.broadcast(sizes), F.lit(True)).select("traj_id", "frame", F.inline("sizes"))
    counts = hits.groupBy("traj_id", "frame", "cluster").agg(F.count("*").alias("n"))
    filled = every.join(counts, ["traj_id", "frame", "cluster"], "left").select("traj_id", "frame", "cluster", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "size")
    q = filled.groupBy("traj_id", "frame").agg(F.sum("n").alias("contacts"), F.sum("size").alias("total"))
    q = q.withColumn("q", F.coalesce(F.col("contacts") / F.nullif("total", F.lit(0)), F.lit(0.0)))
    lists = hits.groupBy("traj_id", "frame").agg(F.array_sort(F.collect_list(F.struct("ord", "i", "j"))).alias("hits"))
    maps = filled.groupBy("traj_id", "frame").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cluster", (F.col("n") / F.col("size")).alias("v"))))).alias("clusters_filling"))
    x = q.join(lists, ["traj_id", "frame"], "left").join(maps, ["traj_id", "frame"])
    listed = F.coalesce(F.transform("hits", lambda h: F.struct(h["i"].alias("i"), h["j"].alias("j"))), F.expr("cast(array() as array<struct<i:int,j:int>>)"))
    return x.select("traj_id", "frame", "contacts", "q", listed.alias("contact_list"), "clusters_filling"), filled, q


def formed(frames: DataFrame, contacts: DataFrame, cutoff: float = 1.2, broadcast_contacts: int = BROADCAST_CONTACTS) -> DataFrame:
    """traj_id, frame, ord, i, j, cluster of the formed contacts."""
    if not is_small(contacts, broadcast_contacts):
        return met(frames, contacts, cutoff)
    return evaluated(frames, contacts, cutoff, broadcast_contacts).filter("formed").drop("formed")


def fill(evaluated_contacts: DataFrame) -> DataFrame:
    """traj_id, frame, cluster, n formed of size; clusters without formed contacts have n = 0.

    Rows of a frame lie together, so partial aggregation leaves one row per frame and cluster for the shuffle.
    """
    return evaluated_contacts.filter("cluster is not null").groupBy("traj_id", "frame", "cluster").agg(F.count_if("formed").alias("n"), F.count("*").alias("size"))


def frame_q(evaluated_contacts: DataFrame) -> DataFrame:
    """traj_id, frame, contacts, total, q; q is 0 without contacts."""
    x = evaluated_contacts.groupBy("traj_id", "frame").agg(F.count_if("formed").alias("contacts"), F.count("ord").alias("total"))
    return x.withColumn("q", F.coalesce(F.col("contacts") / F.nullif("total", F.lit(0)), F.lit(0.0)))


def frame_results(evaluated_contacts: DataFrame) -> DataFrame:
    """traj_id, frame, contacts, q, contact_list (in file order), clusters_filling: the parsed table, by one shuffle on the frame."""
    e = evaluated_contacts
    x = e.groupBy("traj_id", "frame").agg(
        F.count_if("formed").alias("contacts"), F.count("ord").alias("total"),
        F.array_sort(F.collect_list(F.when(F.col("formed"), F.struct("ord", "i", "j")))).alias("hits"),
        F.collect_list(F.when(F.col("ord").isNotNull(), F.struct("cluster", F.col("formed").cast("int").alias("f")))).alias("all"))
    clusters = F.array_sort(F.array_distinct(F.col("all.cluster")))
    filled = F.transform(clusters, lambda c: F.struct(c, (F.size(F.filter("all", lambda a: (a["cluster"] == c) & (a["f"] == 1))) / F.size(F.filter("all", lambda a: a["cluster"] == c))).alias("v")))
    return x.select("traj_id", "frame", "contacts", F.coalesce(F.col("contacts") / F.nullif("total", F.lit(0)), F.lit(0.0)).alias("q"),
                    F.transform("hits", lambda h: F.struct(h["i"].alias("i"), h["j"].alias("j"))).alias("contact_list"), F.map_from_entries(filled).alias("clusters_filling"))


def frame_by_frame(frames: DataFrame, contacts: DataFrame, cutoff: float = 1.2) -> DataFrame:
    """frame_results of a small map, each frame by itself: it gets all contacts as one array, so nothing is shuffled or sorted."""
    sizes = cluster_sizes(contacts).agg(F.array_sort(F.collect_list(F.struct("cluster", "size"))).alias("sizes"))  # one row
    every = contacts.agg(F.array_sort(F.collect_list(F.struct("ord", "i", "j", "r", "cluster"))).alias("every"))  # one row
    x = frames.select("traj_id", "frame", "coords").join(F.broadcast(every), F.lit(True)).join(F.broadcast(sizes), F.lit(True))
    low, high = F.array_min(F.map_keys("coords")), F.array_max(F.map_keys("coords"))
    x = once(x, low=low, places=F.transform(F.sequence(low, high), lambda r: F.try_element_at("coords", r)))
    at = lambda k: F.get("places", k - F.col("low"))
    x = once(x, hits=F.filter("every", lambda c: is_formed(distance(at(c["i"]), at(c["j"])), c["r"], cutoff)))
    filled = F.transform("sizes", lambda s: F.struct(s["cluster"].alias("cluster"), (F.size(F.filter("hits", lambda h: h["cluster"] == s["cluster"])) / s["size"]).alias("v")))
    n = F.size("hits").cast("bigint")
    return x.select("traj_id", "frame", n.alias("contacts"), F.coalesce(n / F.nullif(F.size("every"), F.lit(0)), F.lit(0.0)).alias("q"),
                    F.transform("hits", lambda h: F.struct(h["i"].alias("i"), h["j"].alias("j"))).alias("contact_list"), F.map_from_entries(filled).alias("clusters_filling"))


def filling_long(results: DataFrame) -> DataFrame:
    """traj_id, frame, cluster, value of a parsed table; clusters that only other frames name are 0."""
    known = results.select(F.explode(F.map_keys("clusters_filling")).alias("cluster")).agg(F.array_sort(F.collect_set("cluster")).alias("known"))  # one row
    every = results.select("traj_id", "frame", "clusters_filling").join(F.broadcast(known), F.lit(True))
    value = F.transform("known", lambda c: F.struct(c.alias("cluster"), F.coalesce(F.try_element_at("clusters_filling", c), F.lit(0.0)).alias("value")))
    return every.select("traj_id", "frame", F.inline(value))


def cluster_sizes(contacts: DataFrame) -> DataFrame:
    return contacts.groupBy("cluster").agg(F.count("*").alias("size"))


def read_stats(results: DataFrame) -> DataFrame:
    """frames, min_q, max_q, mean_contacts."""
    return results.agg(F.count("*").alias("frames"), F.min("q").alias("min_q"), F.max("q").alias("max_q"), (F.sum("contacts") / F.nullif(F.count("*"), F.lit(0))).alias("mean_contacts"))
