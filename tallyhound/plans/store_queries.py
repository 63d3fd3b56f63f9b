"""Queries that write versions of stored tables and read them back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyhound.checkpoints import shared_folder
from tallyhound.operators import ingest, lifecycle_store
from tallyhound.plans.sql import CTES, compose
from tallyhound.sources import driver_tables as tables
from tallyhound.sources.versioned import Store

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = compose(sql)
        return f

    return add


#: Orders as actions on their customer's case: assignments, comments, and status changes of which each differs from the one before.
CTES["ac0"] = """
SELECT 'CASE_' || o_custkey AS case_id, lpad(o_orderkey::VARCHAR, 12, '0') AS action_key, o_orderdate AS happened, o_orderkey AS k,
  CASE o_orderkey % 5 WHEN 0 THEN 'assign' WHEN 1 THEN 'comment' ELSE 'status_change' END AS action_type
FROM orders"""
CTES["ac"] = """
SELECT *, CASE WHEN action_type = 'status_change' THEN ['In review', 'Escalated', 'Information requested'][(row_number() OVER (PARTITION BY case_id, action_type ORDER BY happened, action_key) - 1) % 3 + 1] END AS to_status,
  CASE WHEN action_type = 'assign' THEN 'AN_' || (k % 7) END AS assigned_to, CASE WHEN action_type = 'assign' AND k % 2 = 0 THEN 'QUEUE_' || (k % 3) END AS queue
FROM {ac0}"""


def actions(spark, d):
    k = F.col("o_orderkey")
    a = tables.table(spark, d, "orders").select(
        F.concat(F.lit("CASE_"), F.col("o_custkey").cast("string")).alias("case_id"), F.lpad(k.cast("string"), 12, "0").alias("action_key"), F.col("o_orderdate").cast("timestamp_ntz").alias("action_timestamp"),
        F.when(k % 5 == 0, "assign").when(k % 5 == 1, "comment").otherwise("status_change").alias("action_type"), k.alias("k"), F.lit("ana").alias("analyst_id"), F.lit("seen").alias("comment"),
    )
    place = F.row_number().over(Window.partitionBy("case_id", "action_type").orderBy("action_timestamp", "action_key")) - 1
    to = F.element_at(F.array(*[F.lit(s) for s in ("In review", "Escalated", "Information requested")]), (place % 3 + 1).cast("int"))
    assign = F.col("action_type") == "assign"
    return a.withColumns({
        "to_status": F.when(F.col("action_type") == "status_change", to), "assigned_to": F.when(assign, F.concat(F.lit("AN_"), (F.col("k") % 7).cast("string"))),
        "queue": F.when(assign & (F.col("k") % 2 == 0), F.concat(F.lit("QUEUE_"), (F.col("k") % 3).cast("string"))),
    }).drop("k")


def case_store(spark, d) -> Store:
    """All cases, and the actions on them in two transactions: those before 1995, then the others."""
    store = Store(spark, shared_folder(spark))
    every = actions(spark, d)
    lifecycle_store.open_cases(store, every.select("case_id").distinct())
    early = F.col("action_timestamp") < F.lit("1995-01-01").cast("timestamp_ntz")
    for some in (every.filter(early), every.filter(~early)):
        lifecycle_store.apply_actions(store, some)
    return store


@query("lifecycle_apply", """
SELECT case_id, coalesce((max(struct_pack(a := happened, k := action_key, s := to_status)) FILTER (to_status IS NOT NULL)).s, 'New') AS status,
  (max(struct_pack(a := happened, k := action_key, s := assigned_to)) FILTER (action_type = 'assign')).s AS assigned_to,
  (max(struct_pack(a := happened, k := action_key, s := coalesce(queue, ''))) FILTER (action_type = 'assign')).s AS queue, count(*) AS events
FROM {ac} GROUP BY case_id""")  # fmt: skip
def _(spark, d):
    store = case_store(spark, d)
    events = store.read("case_events").groupBy("case_id").agg(F.count("*").alias("events"))
    cases = store.read("cases").join(events, "case_id")
    queue = F.when(F.col("assigned_to").isNotNull(), F.coalesce("queue", F.lit("")))
    return cases.select("case_id", "status", "assigned_to", queue.alias("queue"), "events")


@query("lifecycle_stored_assignments", """
SELECT case_id, m.s AS assigned_to, strftime(m.a, '%Y-%m-%d') AS assigned_on, 'ana' AS assigned_by
FROM (SELECT case_id, max(struct_pack(a := happened, k := action_key, s := assigned_to)) AS m FROM {ac} WHERE action_type = 'assign' GROUP BY case_id)""")  # fmt: skip
def _(spark, d):
    return case_store(spark, d).read("case_assignments").select("case_id", "assigned_to", F.date_format("assigned_at", "yyyy-MM-dd").alias("assigned_on"), "assigned_by")


@query("lifecycle_from_status", """
SELECT action_type, from_status, coalesce(to_status, '') AS to_status, count(*) AS events
FROM (SELECT *, coalesce(last_value(to_status IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY happened, action_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'New') AS from_status FROM {ac})
GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    events = case_store(spark, d).read("case_events")
    return events.groupBy("action_type", "from_status", F.coalesce("to_status", F.lit("")).alias("to_status")).agg(F.count("*").alias("events"))


def silver(spark, d) -> dict:
    """The event bank as silver tables."""
    a, t = tables.event_accounts(spark, d), tables.event_transactions(spark, d)
    return {
        "countries": tables.countries(spark, d), "customers": a.groupBy("customer_id").agg(F.max("customer_risk_rating").alias("customer_risk_rating"), F.min("home_country").alias("jurisdiction")),
        "accounts": a.drop("customer_risk_rating"), "counterparties": t.groupBy("counterparty_id").agg(F.min("destination_country").alias("country_code")),
        "devices": t.select("device_id").distinct(), "transactions": t,
    }


def raw_store(spark, d) -> Store:
    """The silver tables ingested and staged."""
    store = Store(spark, shared_folder(spark))
    ingest.ingest_raw(store, silver(spark, d), run_id="first")
    ingest.stage_raw(store, validate=False, run_id="first")
    return store


_SILVER = """
SELECT 'countries' AS t, count(*) AS n FROM {ctry} UNION ALL SELECT 'customers', count(DISTINCT customer_id) FROM {acc} UNION ALL SELECT 'accounts', count(*) FROM {acc}
UNION ALL SELECT 'counterparties', count(DISTINCT counterparty_id) FROM {tx} UNION ALL SELECT 'devices', count(DISTINCT device_id) FROM {tx}"""


@query("ingest_audit", f"""
SELECT stage, CASE WHEN stage = 'staging' THEN 'stg_' ELSE 'raw_' END || t AS table_name, n AS row_count, 0 AS missing_keys, 'completed' AS status
FROM (SELECT t, n, unnest(['ingest', 'staging']) AS stage FROM ({_SILVER}))
UNION ALL SELECT 'ingest', 'raw_transactions', count(*), 0, 'completed' FROM {{tx}} UNION ALL SELECT 'staging', 'stg_transactions', count(*), 0, 'completed' FROM {{tx}} WHERE amount > 0""")  # fmt: skip
def _(spark, d):
    return raw_store(spark, d).read("audit_events").select("stage", "table_name", "row_count", "missing_keys", "status")


@query("ingest_staged_transactions", """
SELECT transaction_id, sender_account_id, receiver_account_id, amount, strftime(transaction_timestamp, '%Y-%m-%d %H:%M:%S') AS at, transaction_type, is_cross_border FROM {tx} WHERE amount > 0""")  # fmt: skip
def _(spark, d):
    t = raw_store(spark, d).read("stg_transactions")
    return t.select("transaction_id", "sender_account_id", "receiver_account_id", "amount", F.date_format("transaction_timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "transaction_type", "is_cross_border")
