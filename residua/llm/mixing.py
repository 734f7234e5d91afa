"""Mixing sources to target weights: a time-varying curriculum, in DataFrame functions only.

Every source has a share of the training words (its target) and a weight schedule over training time t in [0, 1],
``w(t) = 1 + a * (2t - 1)``.  Its integral ``t + a * (t^2 - t)`` is the part of the source's demand that is met at t.
The documents of a source follow each other in the order of md5(doc_id); a document that starts after a fraction u of
the demand is trained on at the t where the integral reaches u.  Documents are then range-sorted by t.

Cumulative words need a running sum over each source, of which one may hold most rows.  The md5 order is cut into ranges
per source, as many as the number of rows asks for: their totals give each range's offset, and the running sum is over
one range at a time.  Ids that repeat, or are null, have one md5; a range of more than MOST rows is cut once more, by the
rest of the order: md5, size, and a hash of the text among equals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, cut, fresh

WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a range is meant to have, and more of which aren't left in one.
ROWS, MOST = 20_000, 200_000
#: Parts of the rows with one id and size in a range that is cut once more.
TIES = 1024


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, share: float = 1.5, weights=(5, 2, 1), passes: int = 2, slopes=(-0.5, 0.0, 0.5)) -> DataFrame:
    """``totals`` (key, source_size) with each source's target and slope; one row per source.

    Sources in the order of their key weigh ``weights``, repeating, and share ``share`` of all words.  No target exceeds
    ``passes`` times its source; the excess goes to the others by weight.  Sources by cap / weight: the first ones are
    capped, as long as the cap is no more than the source's part of what the earlier ones leave.
    """
    n = F.row_number().over(W.orderBy("key")) - 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    t = totals.withColumns({"weight": pick([int(w) for w in weights]).cast("long"), "slope": pick([float(a) for a in slopes]), "cap": F.col("source_size") * passes})
    before = W.orderBy(F.col("cap") / F.col("weight"), "key").rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = F.lit(0).cast("long")
    t = t.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), zero), "weight_before": F.coalesce(F.sum("weight").over(before), zero), "all": F.sum("source_size").over(every), "weights": F.sum("weight").over(every)})
    left = F.lit(float(share)) * F.col("all") - F.col("cap_before")
    t = t.withColumn("capped", F.col("cap") * (F.col("weights") - F.col("weight_before")) <= left * F.col("weight"))
    got = lambda c: F.sum(F.when(F.col("capped"), F.col(c)).otherwise(zero)).over(every)
    t = t.withColumns({"cap_sum": got("cap"), "weight_sum": got("weight")})
    part = F.col("weight").cast("double") * (F.lit(float(share)) * F.col("all") - F.col("cap_sum")) / F.nullif(F.col("weights") - F.col("weight_sum"), zero)
    return t.select("key", "source_size", "slope", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(part).alias("target"))


def curriculum(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", share=1.5, weights=(5, 2, 1), passes=2, slopes=(-0.5, 0.0, 0.5), buckets: int | None = None, most: int = MOST) -> tuple[DataFrame, dict]:
    """The rows and columns of ``docs`` with size, source_size, target, taken, position (an array, one per pass, null where not taken).

    Returns the frame and the names the new columns got, which never clash.  Null texts have size 0, a null source is a
    source of its own and comes last, null ids count as an empty text, an empty table stays empty.  Rows with equal ids
    follow each other by size, those of one size by a hash of the text; equal rows are interchangeable.  The last document of a source's demand may be taken in
    part: ``taken`` counts words.
    """
    names = dict(zip(n := ["key", "bucket", "order", "size", "source_size", "target", "taken", "position"], fresh(docs, *n), strict=True))
    key, bucket, order, size = (names[x] for x in n[:4])
    code = F.md5(F.coalesce(col(id_col).cast("string"), F.lit("")))
    n_buckets = buckets or max(1024, docs.count() // ROWS)
    rows = docs.withColumns({
        key: F.when(col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), col(source_col).cast("string"))),
        order: code,
        bucket: F.floor(F.conv(F.substring(code, 1, 8), 16, 10).cast("long") * n_buckets / F.lit(2**32)).cast("int"),
        size: word_count(col(text_col)),
    })
    tie, part = f"{order}?", f"{bucket}?"
    rows = rows.withColumn(tie, F.pmod(F.xxhash64(col(text_col)), F.lit(TIES)).cast("int"))
    ranges = cut(rows.groupBy(col(key).alias("key"), col(bucket).alias("bucket")).agg(F.sum(col(size)).alias("words"), F.count("*").alias("rows")))
    large = ranges.filter(F.col("rows") > most)  # fewer than rows / most
    if large.take(1):
        marks = F.broadcast(large.select(F.col("key").alias(key), F.col("bucket").alias(bucket), F.lit(True).alias(part)))
        place = F.concat(col(order), F.lpad(col(size).cast("string"), 19, "0"), F.lpad(col(tie).cast("string"), 4, "0"))  # sorts as the three do
        rows = rows.join(marks, [key, bucket], "left").withColumn(part, F.when(col(part), place).otherwise(""))
        pieces = rows.filter(col(part) != "").groupBy(col(key).alias("key"), col(bucket).alias("bucket"), col(part).alias("part")).agg(F.sum(col(size)).alias("words"))
        ranges = cut(ranges.filter(F.col("rows") <= most).select("key", "bucket", F.lit("").alias("part"), "words").unionByName(pieces))
    else:
        rows, ranges = rows.withColumn(part, F.lit("")), ranges.select("key", "bucket", F.lit("").alias("part"), "words")
    plan = targets(ranges.groupBy("key").agg(F.sum("words").alias("source_size")), share, weights, passes, slopes)
    ahead = F.coalesce(F.sum("words").over(W.partitionBy("key").orderBy("bucket", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    small = cut(ranges.withColumn("ahead", ahead).join(plan, "key").select(
        F.col("key").alias(f"{key}!"), F.col("bucket").alias(f"{bucket}!"), F.col("part").alias(f"{part}!"), F.struct("ahead", "source_size", "slope", "target").alias(f"{size}!")))
    x = rows.join(small, (col(key) == col(f"{key}!")) & (col(bucket) == col(f"{bucket}!")) & (col(part) == col(f"{part}!")))
    plan_of = lambda f: F.col(f"`{size}!`.{f}")
    within = W.partitionBy(col(key), col(bucket), col(part)).orderBy(col(order), col(size), col(tie)).rowsBetween(W.unboundedPreceding, -1)
    start = plan_of("ahead") + F.coalesce(F.sum(col(size)).over(within), F.lit(0).cast("long"))
    x = x.withColumn(f"{order}!", start)
    start, target, a = col(f"{order}!"), plan_of("target"), plan_of("slope")
    demand = F.floor(target).cast("long")
    got = [F.greatest(F.lit(0).cast("long"), F.least(col(size), demand - plan_of("source_size") * p - start)) for p in range(passes)]
    done = [F.least(F.lit(1.0), (plan_of("source_size") * p + start) / F.nullif(target, F.lit(0.0))) for p in range(passes)]
    when = [F.when(g > 0, 2 * u / ((1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * u))) for g, u in zip(got, done, strict=True)]
    x = x.withColumns({names["source_size"]: plan_of("source_size"), names["target"]: target, names["taken"]: sum(got[1:], got[0]), names["position"]: F.array(*when)})
    return x.select(*[col(c) for c in docs.columns], *[col(names[c]) for c in n[3:]]), {c: names[c] for c in n[3:]}


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``, one row per pass, range-sorted by training position.

    A document that the mix takes in part stays whole: the cut falls in the word count, not in the text.
    """
    x, names = curriculum(docs, **options)
    at = fresh(x, "at")[0]
    x = x.withColumn(at, F.explode(F.filter(col(names["position"]), lambda p: p.isNotNull())))
    return x.orderBy(col(at), col(options.get("id_col", "doc_id"))).select(*[col(c) for c in docs.columns])
