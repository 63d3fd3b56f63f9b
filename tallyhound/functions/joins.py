"""Joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of the rows, so there are at most 1 / SHARE hot keys, and at least so many rows.
SHARE, LEAST = 1 / 1024, 100_000
#: Rows are first counted by so many hashes of keys; keys themselves are counted only where a hash has enough rows for a hot one.
HASHES = 4096


def hot_keys(facts: DataFrame, key: str, least: int | None = None, rows: int | None = None) -> DataFrame | None:
    """The hot values of ``key``, at most 1024 rows; None where there are none. ``rows``: the size of ``facts`` where it is known."""
    floor = LEAST if least is None else least
    if rows is not None and rows <= floor:
        return None
    hashed = F.pmod(F.xxhash64(key), F.lit(HASHES))
    counts = facts.groupBy(hashed.alias("_h")).agg(F.count("*").alias("_n")).collect()
    most = max(floor, sum(r["_n"] for r in counts) * SHARE)
    likely = [r["_h"] for r in counts if r["_n"] > most]
    if not likely:
        return None
    hot = facts.filter(hashed.isin(likely)).groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(key).collect()
    return facts.sparkSession.createDataFrame(hot, facts.select(key).schema) if hot else None


def spread_join(facts: DataFrame, one: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``facts`` joined with ``one``, which has at most one row a key. Rows of hot keys stay where they are and get the
    hot rows of ``one`` by broadcast (no more than there are hot keys); only the others are dealt by key."""
    if hot is None:
        return facts.join(one, key, how)
    hot = F.broadcast(hot)
    often = facts.join(hot, key, "left_semi").join(F.broadcast(one.join(hot, key, "left_semi")), key, how)
    return often.unionByName(facts.join(hot, key, "left_anti").join(one, key, how))
