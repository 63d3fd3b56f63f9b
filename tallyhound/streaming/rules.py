"""Streaming forms of what the batch engine does; an extension of our own.

State is bounded by the watermark. Counts per account and window are partial aggregates; duplicates are
dropped by id inside the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def transaction_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of transactions, as they come."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def near_threshold_counts(transactions: DataFrame, threshold: float = 10_000.0, margin: float = 0.9, window: str = "24 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Transfers just below the threshold by sender and sliding window; late rows within the watermark count."""
    t = transactions.withColumn("ts", F.col("transaction_timestamp").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["transaction_id"])
    t = t.filter(F.col("transaction_type").isin("transfer", "wire") & (F.col("amount") >= threshold * margin) & (F.col("amount") < threshold))
    g = t.groupBy(F.window("ts", window, slide).alias("w"), F.col("sender_account_id").alias("account_id")).agg(F.count("*").alias("transaction_count"), F.sum("amount").alias("total_amount"))
    return g.select("account_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "transaction_count", "total_amount")


def activity_sessions(transactions: DataFrame, gap: str = "7 days", late: str = "1 hour") -> DataFrame:
    """Sessions of an account's activity, set apart by a quiet gap."""
    t = transactions.withColumn("ts", F.col("transaction_timestamp").cast("timestamp")).withWatermark("ts", late)
    g = t.groupBy(F.session_window("ts", gap).alias("w"), F.col("sender_account_id").alias("account_id")).agg(F.count("*").alias("transaction_count"), F.sum("amount").alias("total_amount"))
    return g.select("account_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "transaction_count", "total_amount")
