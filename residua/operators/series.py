"""Row-count windows over ordered frames: centered running means and tumbling means.

Series carry counts (n of size); means are sums of integers, or of decimals where values are floats, divided once, so they
don't depend on the order of summing.
Positions and running sums of one long trajectory are found in ranges of frames, so that no series is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import binary

#: Frame numbers, or positions, that one window task gets at a time.
RANGE = 1 << 20


def positioned(df: DataFrame, by: list[str], order: str = "frame", width: int = RANGE, ties: list[str] | None = None) -> DataFrame:
    """``df`` with ``pos``: the place of each row among those with equal ``by``, from 0, by ``order`` (an integer column).

    Ranges of ``width`` order values are numbered apart and offset by the counts of the earlier ones.
    """
    x = df.withColumn("_range", F.floor(F.col(order) / F.lit(width)))
    counts = x.groupBy(*by, "_range").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*by, "_range", before.alias("_before"))
    own = F.row_number().over(W.partitionBy(*by, "_range").orderBy(order, *(ties or [])))
    return x.join(offsets, [*by, "_range"]).withColumn("pos", (own - 1 + F.col("_before")).cast("bigint")).drop("_range", "_before")


def centered(df: DataFrame, by: list[str], sums: dict[str, Column], window: int, width: int = RANGE) -> DataFrame:
    """``df`` (with ``pos``) with the sum of each integer in ``sums`` over [pos - w // 2, pos + w // 2], and ``rows``, how many rows that are.

    Each block of positions also gets the w // 2 rows on both sides of it; sums are differences of running sums.
    """
    h = max(0, window) // 2
    width = max(width, 4 * h, 1)
    low, high = F.floor(F.greatest(F.lit(0).cast("bigint"), F.col("pos") - h) / width), F.floor((F.col("pos") + h) / width)
    x = df.withColumn("_block", F.explode(F.sequence(low, high)))
    w = W.partitionBy(*by, "_block").orderBy("pos")
    upto, whole = w.rowsBetween(W.unboundedPreceding, W.currentRow), w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = F.lit(0).cast("bigint")
    parts = {**sums, "rows": F.lit(1).cast("bigint")}
    x = x.withColumns({f"_{k}": F.sum(c).over(upto) for k, c in parts.items()})
    x = x.withColumns({k: F.coalesce(F.lead(f"_{k}", h).over(w), F.last(f"_{k}").over(whole)) - F.coalesce(F.lag(f"_{k}", h + 1).over(w), zero) for k in parts})
    return x.filter(F.floor(F.col("pos") / width) == F.col("_block")).drop("_block", *(f"_{k}" for k in parts))


def smooth(fill: DataFrame, window: int = 100, width: int = RANGE) -> DataFrame:
    """traj_id, frame, cluster, value: the running mean of n / size over w // 2 rows on both sides, clipped at the ends.

    An even window averages one row more than its number; 0 and 1 change nothing.
    """
    x = positioned(fill, ["traj_id", "cluster"], width=width)
    x = centered(x, ["traj_id", "cluster"], {"_sum": F.col("n")}, window, width)
    return x.select("traj_id", "frame", "cluster", (F.col("_sum").cast("double") / (F.col("size") * F.col("rows"))).alias("value"))


def smooth_q(q: DataFrame, window: int = 100, width: int = RANGE) -> DataFrame:
    """traj_id, frame, q_smooth of the counts of frame_q."""
    x = positioned(q, ["traj_id"], width=width)
    x = centered(x, ["traj_id"], {"_sum": F.col("contacts")}, window, width)
    return x.select("traj_id", "frame", F.coalesce(F.col("_sum").cast("double") / F.nullif(F.col("total") * F.col("rows"), F.lit(0)), F.lit(0.0)).alias("q_smooth"))


#: Digits of a float that sums of floats keep: 20 before the point and 18 after it.
EXACT = "decimal(38,18)"


def exact_parts(value: Column) -> dict[str, Column]:
    """What is summed of a float column so that its sum is the same in any order: its decimal, and how often it is none."""
    finite = ~(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))))
    bad = F.raise_error(F.concat(F.lit("too large to sum: "), value.cast("string"))).cast("double")
    digits = F.when(finite, F.when(F.abs(value) < 1e19, value).otherwise(bad)).otherwise(F.lit(0.0)).cast(EXACT)
    one = lambda c: F.when(c, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return {"_sum": digits, "_nan": one(F.isnan(value)), "_up": one(value == F.lit(float("inf"))), "_down": one(value == F.lit(float("-inf")))}


def exact_mean(rows: Column) -> Column:
    """The mean of the sums of exact_parts: one division of a sum without rounding; not a number, or infinite, as any order of summing has it."""
    inf = F.lit(float("inf"))
    return F.when((F.col("_nan") > 0) | ((F.col("_up") > 0) & (F.col("_down") > 0)), F.lit(float("nan"))).when(F.col("_up") > 0, inf).when(F.col("_down") > 0, -inf).otherwise(F.col("_sum").cast("double") / rows)


def smooth_values(series: DataFrame, window: int = 100, value: str = "value", by: tuple[str, ...] = ("traj_id", "cluster"), width: int = RANGE) -> DataFrame:
    """The running mean of float values, for series read back from text; values have no nulls.

    Sums are of decimals, so a mean has the same bits however the rows are dealt; digits beyond EXACT are rounded first.
    """
    if not max(0, window) // 2:
        return series
    x = centered(positioned(series, [*by], width=width), [*by], exact_parts(F.col(value)), window, width)
    return x.withColumn(value, exact_mean(F.col("rows"))).select(*series.columns)


def summarize(fill: DataFrame, window_size: int = 10_000, cutoff: float | None = None, width: int = RANGE) -> DataFrame:
    """traj_id, widx, frame (the window's first), cluster, value: means of consecutive windows of ``window_size`` rows.

    Windows are cut by position, not by frame number; the last may be short and is averaged over its real length.  With
    a cutoff values are 1 where the mean reaches it and 0 elsewhere.
    """
    if window_size <= 0:
        raise ValueError("window_size must be positive")
    x = positioned(fill, ["traj_id", "cluster"], width=width).withColumn("widx", F.floor(F.col("pos") / window_size).cast("bigint"))
    mean = F.sum("n").cast("double") / (F.max("size") * F.count("*"))
    x = x.groupBy("traj_id", "widx", "cluster").agg(F.min("frame").alias("frame"), mean.alias("value"))
    return x.select("traj_id", "widx", "frame", "cluster", (F.col("value") if cutoff is None else binary(F.col("value"), cutoff)).alias("value"))


def summarize_values(series: DataFrame, window_size: int = 10_000, cutoff: float | None = None) -> DataFrame:
    """The same of float values (traj_id, frame, cluster, value), in the same bits however the rows are dealt."""
    if window_size <= 0:
        raise ValueError("window_size must be positive")
    x = positioned(series, ["traj_id", "cluster"]).withColumn("widx", F.floor(F.col("pos") / window_size).cast("bigint"))
    parts = [F.sum(c).alias(k) for k, c in exact_parts(F.col("value")).items()]
    x = x.groupBy("traj_id", "widx", "cluster").agg(F.min("frame").alias("frame"), F.count("*").alias("rows"), *parts).withColumn("value", exact_mean(F.col("rows")))
    return x.select("traj_id", "widx", "frame", "cluster", (F.col("value") if cutoff is None else binary(F.col("value"), cutoff)).alias("value"))


def summary_shape(summary: DataFrame) -> DataFrame:
    return summary.agg(F.countDistinct("traj_id", "widx").alias("windows"), F.countDistinct("cluster").alias("clusters"))


def summary_counts(summary: DataFrame, cutoff: float) -> DataFrame:
    """cluster, windows, formed: of a summary, floats or not, the windows of each cluster and those that reach the cutoff."""
    return summary.groupBy("cluster").agg(F.count("*").alias("windows"), F.count_if(F.col("value") >= F.lit(float(cutoff))).alias("formed"))


def wide(series: DataFrame, keys: list[str], clusters: list[int], suffix: str = "") -> DataFrame:
    """One column cluster_<n><suffix> per cluster, in the given order; for sinks."""
    x = series.groupBy(*keys).pivot("cluster", clusters).agg(F.first("value"))
    return x.select(*keys, *(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(f"cluster_{c}{suffix}") for c in clusters))
