"""Large contact maps by blocks of residues, against the way of small maps."""

import random

import pytest
from pyspark.sql import functions as F

from residua.operators import blocks, formation

CONTACTS = "ord bigint, i int, j int, r double, cluster int"


def trajectory(spark, rng, frames, residues, absent=0.1):
    rows = [(f"t{t}", f, r, rng.gauss(0, 5), rng.gauss(0, 5), rng.gauss(0, 5)) for t in range(2) for f in range(-1, frames) for r in residues if rng.random() > absent]
    return formation.pack(spark.createDataFrame(rows, "traj_id string, frame int, residue int, x double, y double, z double")).cache()


def content(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("options", [{}, {"residues": 3, "chunk": 4, "salts": 2}, {"residues": 1, "blocks": 7, "chunk": 1, "salts": 1}, {"residues": 5, "blocks": 2, "chunk": 10, "salts": 50}])
def test_blocks_equal_the_broadcast_way(spark, options):
    rng = random.Random(1)
    residues = [-7, -6, 0, 1, 2, 3, 5, 8, 13, 21, 22, 23, 60]
    frames = trajectory(spark, rng, 9, residues)
    rows = [(k, rng.choice([*residues, 40, 61]), rng.choice([*residues, -9]), rng.choice([5.0, 8.0, 12.0, float("nan"), float("inf"), None]), rng.randrange(3)) for k in range(120)]
    rows += [(200 + k, 1, 8, 9.0, k % 2) for k in range(15)]  # one contact many times
    contacts = spark.createDataFrame(rows, CONTACTS)
    small = formation.evaluated(frames, contacts).select("traj_id", "frame", "ord", "i", "j", "cluster", "formed")
    assert content(blocks.met(frames, contacts, every=True, **options)) == content(small)
    want = content(small.filter("formed").drop("formed"))
    assert content(blocks.met(frames, contacts, **options)) == want and want
    assert content(formation.formed(frames, contacts, broadcast_contacts=0)) == want
    assert content(blocks.met(frames, contacts, 0.5, **options)) == content(formation.formed(frames, contacts, 0.5))


def test_empty_sides(spark):
    frames = trajectory(spark, random.Random(2), 2, [1, 2])
    contacts = spark.createDataFrame([(1, 1, 2, 50.0, 1)], CONTACTS)
    assert blocks.met(frames, contacts.limit(0)).collect() == [] == blocks.met(frames.limit(0), contacts).collect()
    assert blocks.met(frames, contacts, every=True).columns == ["traj_id", "frame", "ord", "i", "j", "cluster", "formed"]


def test_numbers_as_trajectories(spark):
    frames = trajectory(spark, random.Random(3), 3, [1, 2], absent=0).withColumn("traj_id", F.substring("traj_id", 2, 1).cast("bigint"))
    x = blocks.met(frames, spark.createDataFrame([(1, 1, 2, 500.0, 1)], CONTACTS))
    assert x.schema["traj_id"].dataType.simpleString() == "bigint" and content(x) == [(t, f, 1, 1, 2, 1) for t in (0, 1) for f in (-1, 0, 1, 2)]


def test_no_place_has_more_than_its_share(spark):
    """Many contacts of one residue: still no place gets more than a chunk of contacts and a class of frames."""
    rng, n = random.Random(4), 63
    frames = trajectory(spark, rng, n, range(1, 201), absent=0)
    contacts = spark.createDataFrame([(k, 1, 1 + k % 200, 10.0, k % 4) for k in range(6_000)], CONTACTS)
    sent = blocks._packed(frames, "string", [(0, b, 2) for b in range(4)], 1, 50, 8)
    places = sent.groupBy(*blocks.PLACE).count().collect()
    assert len(places) == 4 * 2 * 8 and {r["count"] for r in places} == {2 * (n + 1) // 8}
    got = blocks.met(frames, contacts, residues=50, chunk=750, salts=8).groupBy("traj_id", "frame", "cluster").count()
    assert content(got) == content(formation.formed(frames, contacts).groupBy("traj_id", "frame", "cluster").count())
