"""The test tables as a bank: transactions, accounts, customers, countries.

Only arithmetic that any engine repeats exactly is used to derive identifiers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plus_one(frame: DataFrame, column: str) -> DataFrame:
    """One row: the largest value and one."""
    return F.broadcast(frame.agg((F.max(column) + 1).alias("_n")))


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    event, user = F.col("event_id"), F.col("user_id")
    kinds = F.create_map(*[F.lit(x) for x in ("view", "transfer", "click", "wire", "purchase", "card_payment", "signup", "cash_deposit", "error", "cash_withdrawal")])
    origin, destination = F.concat(F.lit("C"), (user % 25).cast("string")), F.concat(F.lit("C"), (event % 25).cast("string"))
    return e.crossJoin(_plus_one(e, "user_id")).select(
        F.concat(F.lit("TXN_"), event.cast("string")).alias("transaction_id"),
        F.concat(F.lit("ACC_"), user.cast("string")).alias("sender_account_id"),
        F.when(event % 5 != 0, F.concat(F.lit("ACC_"), ((user * 31 + event * 17) % F.col("_n")).cast("string"))).alias("receiver_account_id"),
        F.concat(F.lit("CP_"), (event % 40).cast("string")).alias("counterparty_id"),
        F.concat(F.lit("DEV_"), (event % 50).cast("string")).alias("device_id"),
        F.col("ts").cast("timestamp_ntz").alias("transaction_timestamp"),
        F.round(F.col("value") * 200, 2).cast("decimal(18,2)").alias("amount"),
        F.lit("USD").alias("currency"),
        kinds[F.col("event_type")].alias("transaction_type"),
        F.lit("online").alias("channel"),
        origin.alias("origin_country"),
        destination.alias("destination_country"),
        (origin != destination).alias("is_cross_border"),
    )


def order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    kind = F.when(F.col("o_orderpriority").startswith("1"), "transfer").when(F.col("o_orderpriority").startswith("2"), "wire").otherwise("cash_withdrawal")
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    return o.crossJoin(_plus_one(c, "c_custkey")).select(
        F.concat(F.lit("ORD_"), key.cast("string")).alias("transaction_id"),
        F.concat(F.lit("A"), customer.cast("string")).alias("sender_account_id"),
        F.concat(F.lit("A"), ((customer * 7 + key * 13) % F.col("_n")).cast("string")).alias("receiver_account_id"),
        F.lit(None).cast("string").alias("counterparty_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("transaction_timestamp"),
        F.round("o_totalprice", 2).cast("decimal(18,2)").alias("amount"),
        kind.alias("transaction_type"),
    )


def event_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    rating = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high"), F.lit("unknown")), (user % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("user_id").distinct().select(
        F.concat(F.lit("ACC_"), user.cast("string")).alias("account_id"),
        F.concat(F.lit("CUST_"), F.floor(user / 2).cast("string")).alias("customer_id"),
        F.lit("current").alias("account_type"),
        F.when(user % 10 == 9, "closed").otherwise("active").alias("account_status"),
        F.lit("USD").alias("currency"),
        F.concat(F.lit("C"), (user % 25).cast("string")).alias("home_country"),
        rating.alias("customer_risk_rating"),
    )


def order_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("A"), key).alias("account_id"), F.concat(F.lit("CUST_"), key).alias("customer_id"), F.concat(F.lit("C"), F.col("c_nationkey").cast("string")).alias("home_country"), F.lower("c_mktsegment").alias("customer_risk_rating"))


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("C"), key.cast("string")).alias("country_code"), F.col("n_name").alias("country_name"), F.col("n_regionkey").cast("string").alias("region"), (key % 6 == 0).alias("is_high_risk"), F.when(key % 7 != 3, (key * 4 % 101).cast("double")).alias("risk_score"))
