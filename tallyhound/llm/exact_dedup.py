"""Exact dedup by skew-safe combining, in DataFrame operations only.

1. Every text is normalised and digested; (id, digest) is staged.
2. Local dedup: the partial aggregate over (digest, salt, text) merges equal texts inside a map task.
3. Salted merge: a digest held by more than 1/1024 of the rows (so at most 1024 digests: the broadcast
   list has a proven bound) is spread over ``salts`` salts by map task; all others have one salt. Full
   texts are group keys, so a digest collision never merges two texts.
4. Global combine: only hot digests have several salt winners; they merge by (digest, full text). The
   others pass through without their text.
5. Rows find their class by digest; classes of hot digests are broadcast (at most 1024 digests), so no task gets
   all their rows. Where a digest is shared by different texts, and only there, the join also compares the texts.

Text crosses the network once. Cases: a null text counts as empty; a null id never wins against a
number, and a group whose ids are all null has a null ``keep_id`` and its rows count as kept; rows that
repeat both id and text carry the same flags (``exact_dedup`` decides on rows: it keeps one row of each text, of
those that share the smallest id the first read); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.llm.staging import free_name, numbered, stage, with_class

HOT_DIGESTS = 1024


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_hex,
    salts: int = 64,
    hot_least: int = 1000,
    row_col: str | None = None,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest. With ``row_col``, a number of each row, also row,
    and kept for one row of each text."""
    row = F.col(row_col).cast("long") if row_col else F.lit(None).cast("long")
    keyed = docs.select(F.col(id_col).alias("id"), row.alias("row"), normalised(F.col(text_col)).alias("t")).withColumn("digest", digest(F.col("t")))
    keys = stage(keyed.select("id", "row", "digest"), "exact-keys")

    least = max(hot_least, keys.count() // HOT_DIGESTS)
    hot = keys.groupBy("digest").count().filter(F.col("count") > least).select("digest", F.lit(True).alias("hot"))
    local = keyed.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.when(F.col("hot"), F.spark_partition_id() % salts).otherwise(0))
    # the smallest of these comes first: numbers before nulls, then the row
    mine = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    winners = local.groupBy("digest", "salt", "hot", "t").agg(F.min(mine).alias("win"), F.count("*").alias("n"))
    # a winner of a digest with one salt is alone with its text: it passes on as (solo, solo_win), textless
    winners = winners.select("digest", "win", "n", F.when(F.col("hot"), F.col("t")).alias("t"), F.when(F.col("hot").isNull(), F.xxhash64("t")).alias("solo"), F.when(F.col("hot").isNull(), F.col("win")).alias("solo_win"))
    merged = winners.groupBy("digest", "t", "solo", "solo_win").agg(F.min("win").alias("win"), F.sum("n").alias("group_size"))
    classes = stage(merged.select("digest", F.col("win.id").alias("keep_id"), F.col("win.row").alias("keep_row"), "group_size"), "exact-classes")

    of_digest = classes.groupBy("digest").agg(F.count("*").alias("texts"))
    shared = of_digest.filter("texts > 1").select("digest")
    if shared.isEmpty():
        found = with_class(keys, classes, "digest", "group_size", least)
    else:
        # different texts under one digest: their rows also compare the text of the class's first row
        shared = stage(shared, "exact-collisions")
        alike = classes.join(shared, "digest", "left_semi")
        theirs = keyed.join(shared, "digest", "left_semi")
        first = theirs.select("digest", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), "t").distinct()
        same = alike.keep_id.eqNullSafe(first.keep_id) & alike.keep_row.eqNullSafe(first.keep_row) & (alike.digest == first.digest)
        named = alike.join(first, same).select(alike.digest, "t", alike.keep_id, alike.keep_row, "group_size")
        columns = ["id", "row", "digest", "keep_id", "keep_row", "group_size"]
        found = keys.join(classes.join(shared, "digest", "left_anti"), "digest").select(columns).unionByName(theirs.join(named, ["digest", "t"]).select(columns))
    kept = F.col("row") == F.col("keep_row") if row_col else F.col("id").eqNullSafe(F.col("keep_id"))
    return found.select("id", "keep_id", "group_size", kept.alias("kept"), "digest", *(["row"] if row_col else []))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each text, all their columns untouched."""
    row = free_name(docs)
    rows = numbered(docs, "exact-rows", row)
    keep = exact_classes(rows, id_col, text_col, row_col=row).filter("kept").select(F.col("row").alias(row))
    return rows.join(keep, row, "left_semi").select(docs.columns)
