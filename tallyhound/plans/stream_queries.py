"""Queries that replay a given table as a stream; their SQL is the batch rules'."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.checkpoints import checkpointed, shared_folder
from tallyhound.functions import ids
from tallyhound.operators import rules
from tallyhound.plans import rule_queries
from tallyhound.sources import driver_tables as tables
from tallyhound.streaming import stateful
from tallyhound.streaming.rules import transaction_stream

QUERIES: dict = {}
SQL: dict[str, str] = {}
LATE_HOURS, SLICES = 24, 3


def replayed(transactions: DataFrame, detect: Callable[[DataFrame, str], DataFrame], width: int) -> DataFrame:
    """The detections of ``detect`` over a table that arrives in slices of time, a tenth of the rows up to half the allowed
    lateness late. The stream stops after each slice and goes on from its checkpoint with the next; a last row, of a
    kind that no rule counts, moves time past every window."""
    spark, late = transactions.sparkSession, LATE_HOURS * rules.HOUR
    folder = shared_folder(spark)
    us = ids.micros(F.col("transaction_timestamp"))
    arrives = us + F.when(F.pmod(F.xxhash64("transaction_id"), F.lit(10)) == 0, late // 2).otherwise(0)
    rows = checkpointed(transactions.withColumn("_at", arrives))
    low, high = rows.agg(F.min("_at"), F.max("_at")).first()
    if low is None:
        low = high = 0
    span = (high - low) // SLICES + 1
    columns = transactions.columns
    last = {"transaction_id": F.lit("END"), "sender_account_id": F.lit("END"), "transaction_timestamp": F.timestamp_micros(F.lit(high + width + 2 * late)).cast("timestamp_ntz"), "amount": F.lit(1).cast("decimal(18,2)"), "transaction_type": F.lit("end")}
    types = {f.name: f.dataType for f in transactions.schema}
    end = spark.range(1).select(*[last.get(c, F.lit(None)).cast(types[c]).alias(c) for c in columns])
    parts = [rows.filter(F.floor((F.col("_at") - low) / span) == k).select(*columns) for k in range(SLICES)]
    for part in [*parts, end]:
        part.write.mode("append").parquet(f"{folder}/in")
        stream = transaction_stream(spark, f"{folder}/in", transactions.schema.simpleString()[7:-1].replace(":", " "))
        stateful.start(detect(stream, f"{LATE_HOURS} hours"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return stateful.newest(spark.read.schema(stateful.FOUND).parquet(f"{folder}/out"))


def stream_structuring(spark, d):
    c = rule_queries.STRUCTURING
    found = replayed(tables.event_transactions(spark, d), lambda t, late: stateful.structuring_stream(t, c, late), c.window_hours * rules.HOUR)
    return rule_queries.joined(stateful.structuring_detections(found))


def stream_dormant_reactivation(spark, d):
    c = rule_queries.DORMANT
    found = replayed(tables.order_transactions(spark, d), lambda t, late: stateful.dormant_stream(t, c, late), c.window_days * rules.DAY)
    return rule_queries.joined(stateful.dormant_detections(found, c).drop("reactivation_evidence_ids"))


QUERIES["stream_structuring"] = stream_structuring
QUERIES["stream_dormant_reactivation"] = stream_dormant_reactivation
SQL["stream_structuring"] = rule_queries.SQL["rule_structuring_windows"]
SQL["stream_dormant_reactivation"] = rule_queries.SQL["rule_dormant_reactivation_windows"]
