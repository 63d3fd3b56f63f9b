"""Ranking helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.checkpoints import checkpointed
from tallyhound.functions.joins import hot_keys, spread_join


def latest_per_key(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def running(frame: DataFrame, order: list[Column], sums: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Running totals ``sums`` (source: target) in a total order, for each value of ``by``; and the totals as
    ``target_total``. Ranges of the order are summed on their own and shifted by those before them: no task gets all
    rows, and what is broadcast has one row a range."""
    by = by or []
    ranged = checkpointed(frame.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    parts = ranged.groupBy(*by, "_range").agg(*(F.sum(s).alias(f"_{t}") for s, t in sums.items()))
    key = Window.partitionBy(*by)
    earlier = key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(*by, "_range", *(F.coalesce(F.sum(f"_{t}").over(earlier), F.lit(0)).alias(f"_{t}") for t in sums.values()), *(F.sum(f"_{t}").over(key).alias(f"{t}_total") for t in sums.values()))
    upto = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({t: F.sum(s).over(upto) for s, t in sums.items()})
    out = local.join(F.broadcast(shifts), [*by, "_range"])
    return out.withColumns({t: F.col(t) + F.col(f"_{t}") for t in sums.values()}).drop("_range", *(f"_{t}" for t in sums.values()))


def percentile_ranks(frame: DataFrame, columns: dict[str, str], single: bool = False) -> DataFrame:
    """Average-rank percentiles (0 to 100) of ``columns`` (source: target), nulls as 0.

    Values of all columns are counted first and ranked in one pass over ranges of them; the result is joined back by
    value. ``single``: a frame of one row scores 100 if positive, else 0.
    """
    frame = checkpointed(frame)  # read once for each column below
    size = frame.count()
    value = {s: F.coalesce(F.col(s).cast("double"), F.lit(0.0)) for s in columns}
    pairs = frame.select(F.explode(F.array(*(F.struct(F.lit(s).alias("_c"), value[s].alias("_v")) for s in columns))).alias("p")).select("p.*")
    counts = running(pairs.groupBy("_c", "_v").agg(F.count("*").alias("_n")), [F.asc("_v")], {"_n": "_upto"}, ["_c"])
    percent = (F.col("_upto") - (F.col("_n") - 1) / 2) / F.col("_upto_total") * 100
    if single:
        percent = F.when(F.col("_upto_total") == 1, F.when(F.col("_v") > 0, 100.0).otherwise(0.0)).otherwise(percent)
    ranks = checkpointed(counts.select("_c", "_v", percent.alias("_percent")))
    out = frame
    for source, target in columns.items():
        mine = ranks.filter(F.col("_c") == source).select("_v", F.col("_percent").alias(target))
        out = out.withColumn("_v", value[source])
        # most rows may share one value, such as no alerts
        out = spread_join(out, mine, "_v", hot_keys(frame.select(value[source].alias("_v")), "_v", rows=size), "left").drop("_v")
    return out


def band(score: Column, medium: float = 50, high: float = 75, critical: float = 90) -> Column:
    return F.when(score >= critical, "critical").when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def anomaly_band(score: Column) -> Column:
    return F.when(score >= 95, "high").when(score >= 80, "medium").otherwise("low")


def gold_band(score: Column) -> Column:
    """Cut at 40, 70 and 90, without gaps between whole numbers."""
    return band(score, 40, 70, 90)


def nearest(value: Column | str, places: int) -> Column:
    """Rounded as the SQL's engine does: on the product in binary, where what looks like a tie in decimals may be none."""
    return F.round((F.col(value) if isinstance(value, str) else value) * 10**places) / 10**places


def global_rank(frame: DataFrame, order: list[Column], name: str) -> DataFrame:
    """1..n in the given total order, without gathering the rows in one task: ranges of the order are numbered
    on their own, and each range is shifted by the sizes of those before it (one row a range)."""
    ranged = checkpointed(frame.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = F.broadcast(sizes.select("_range", before.alias("_before")))
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_local", local).join(shifts, "_range").withColumn(name, F.col("_before") + F.col("_local")).drop("_range", "_local", "_before")
