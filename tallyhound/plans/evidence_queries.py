"""Queries of evidence as payloads and rows, of summaries with bands, and of lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.checkpoints import checkpointed
from tallyhound.functions import payload
from tallyhound.functions.analytic import anomaly_band
from tallyhound.operators import cases, read_api, security
from tallyhound.plans import case_queries as cq
from tallyhound.plans.sql import CTES, compose, iso
from tallyhound.sources import driver_tables as tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = compose(sql)
        return f

    return add


def packs(spark, d) -> DataFrame:
    made, alerts, scores, g, scored = cq.scored_cases(spark, d)
    return checkpointed(cases.evidence_packs(made, alerts, tables.event_transactions(spark, d), scores, cq.anomalies(spark, d), g, scored))


CTES["pk_a"] = "SELECT c.case_id, l.*, row_number() OVER (PARTITION BY c.case_id ORDER BY risk_score_rule DESC, alert_id) AS k FROM (SELECT case_id, unnest(alert_ids) AS alert_id FROM {cs}) c JOIN {al} l USING (alert_id)"
CTES["pk_al"] = """
SELECT case_id, {'alert_count': count(*), 'alerts': list({'alert_id': alert_id, 'detection_window_start': detection_window_start, 'reason_code': reason_code,
  'risk_score_rule': risk_score_rule, 'rule_name': rule_name, 'severity': severity} ORDER BY k)} AS alert_evidence
FROM {pk_a} WHERE k <= 50 GROUP BY case_id"""
CTES["pk_t"] = "SELECT c.case_id, t.*, row_number() OVER (PARTITION BY c.case_id ORDER BY amount DESC, transaction_id) AS k FROM (SELECT case_id, unnest(transaction_ids) AS transaction_id FROM {cs}) c JOIN {tx} t USING (transaction_id)"
CTES["pk_tx"] = f"""
SELECT case_id, {{{{'counterparty_count': count(DISTINCT counterparty_id), 'country_count': count(DISTINCT destination_country), 'first_at': {iso('min(transaction_timestamp)')}, 'last_at': {iso('max(transaction_timestamp)')},
  'max_value': max(amount), 'total_value': CAST(sum(amount) AS DECIMAL(28,2)), 'transaction_count': count(*),
  'transactions': list({{{{'amount': amount, 'transaction_id': transaction_id, 'transaction_timestamp': {iso('transaction_timestamp')}, 'transaction_type': transaction_type}}}} ORDER BY k) FILTER (k <= 100)}}}} AS transaction_evidence
FROM {{pk_t}} GROUP BY case_id""".replace("{{", "{").replace("}}", "}")


@query("case_evidence_payloads", """
SELECT case_id, to_json({'alert_evidence': alert_evidence, 'case_id': case_id, 'primary_account_id': primary_account_id, 'severity': severity, 'summary': summary, 'transaction_evidence': transaction_evidence}) AS payload
FROM {cs} LEFT JOIN {pk_al} USING (case_id) LEFT JOIN {pk_tx} USING (case_id)""")  # fmt: skip
def _(spark, d):
    p = packs(spark, d)
    return p.select("case_id", payload.json_object(p, ["case_id", "primary_account_id", "severity", "summary", "alert_evidence", "transaction_evidence"]).alias("payload"))


@query("case_payload_fields", """
SELECT case_id, len(alert_ids) AS alerts, (SELECT CAST(transaction_evidence.total_value AS DOUBLE) FROM {pk_tx} t WHERE t.case_id = c.case_id) AS total_value,
  (SELECT alert_id FROM {pk_a} a WHERE a.case_id = c.case_id AND k = 1) AS first_alert, CAST(NULL AS VARCHAR) AS missing
FROM {cs} c""")  # fmt: skip
def _(spark, d):
    """Read back from the whole payloads."""
    p = packs(spark, d)
    text = p.select("case_id", payload.json_object(p, [c for c in p.columns if c != "case_id"]).alias("payload"))
    get = lambda path, kind="string": payload.field(F.col("payload"), path, kind)
    return text.select("case_id", get("$.alert_evidence.alert_count", "long").alias("alerts"), get("$.transaction_evidence.total_value", "double").alias("total_value"), get("$.alert_evidence.alerts[0].alert_id").alias("first_alert"), get("$.nothing.there").alias("missing"))


CTES["pk_ac"] = """
SELECT case_id, account_id, s.account_risk_score, s.risk_band, a.anomaly_risk_score, g.pagerank_score, g.cycle_count,
  row_number() OVER (PARTITION BY case_id ORDER BY s.account_risk_score DESC, account_id) AS k
FROM (SELECT case_id, unnest(account_ids) AS account_id FROM {cs}) JOIN {score} s USING (account_id) LEFT JOIN {s_an} a USING (account_id) LEFT JOIN {gf} g USING (account_id)"""


@query("case_account_evidence", "SELECT case_id, k AS place, account_id, round(account_risk_score, 4) AS account_risk_score, risk_band, anomaly_risk_score AS anomaly_score FROM {pk_ac} WHERE k <= 50")
def _(spark, d):
    p = packs(spark, d).select("case_id", F.posexplode("account_evidence.accounts").alias("at", "a"))
    return p.select("case_id", (F.col("at") + 1).cast("long").alias("place"), "a.account_id", cq.nearest("a.account_risk_score", 4).alias("account_risk_score"), "a.risk_band", "a.anomaly_score")


@query("case_graph_evidence", """
SELECT case_id, round(max(pagerank_score), 6) AS max_pagerank, CAST(sum(cycle_count) AS BIGINT) AS cycles, count(*) AS accounts, string_agg(account_id, '|' ORDER BY k) AS account_ids
FROM {pk_ac} WHERE k <= 50 GROUP BY case_id""")  # fmt: skip
def _(spark, d):
    g = F.col("graph_evidence")
    ids = F.array_join(F.transform(g["accounts"], lambda x: x["account_id"]), "|")
    return packs(spark, d).select("case_id", F.round(g["max_pagerank"], 6).alias("max_pagerank"), g["cycles"].cast("long").alias("cycles"), F.size(g["accounts"]).cast("long").alias("accounts"), ids.alias("account_ids"))


@query("case_transaction_list", "SELECT case_id, k AS place, transaction_id, amount, transaction_type FROM {pk_t} WHERE k <= 100")
def _(spark, d):
    p = packs(spark, d).select("case_id", F.posexplode("transaction_evidence.transactions").alias("at", "t"))
    return p.select("case_id", (F.col("at") + 1).cast("long").alias("place"), "t.transaction_id", "t.amount", "t.transaction_type")


@query("case_review_focus", """
SELECT case_id, array_to_string(list_filter([
  CASE WHEN v > 0 THEN 'Verify legitimacy of high-value counterparties.' END, CASE WHEN n > 0 THEN 'Inspect graph community and proximity to flagged activity.' END,
  CASE WHEN n > 0 THEN 'Compare account activity against customer profile and account risk score.' END,
  CASE WHEN m >= 75 THEN 'Review high anomaly accounts and behavioural deviation.' END, CASE WHEN len(alert_ids) > 1 THEN 'Review repeated alerts and shared reason codes.' END], lambda x: x IS NOT NULL), '|') AS recommended_review_focus
FROM {cs} LEFT JOIN (SELECT case_id, max(amount) AS v FROM {pk_t} GROUP BY case_id) USING (case_id)
  LEFT JOIN (SELECT case_id, count(*) AS n, max(anomaly_risk_score) AS m FROM {pk_ac} WHERE k <= 50 GROUP BY case_id) USING (case_id)""")  # fmt: skip
def _(spark, d):
    return packs(spark, d).select("case_id", F.array_join("recommended_review_focus", "|").alias("recommended_review_focus"))


@query("case_evidence_quality", """
SELECT case_id, least(50, len(alert_ids)) AS alerts, coalesce(t, 0) AS transactions, coalesce(n, 0) AS accounts, true AS scored
FROM {cs} LEFT JOIN (SELECT case_id, count(*) AS t FROM {pk_t} GROUP BY case_id) USING (case_id) LEFT JOIN (SELECT case_id, count(*) AS n FROM {pk_ac} WHERE k <= 50 GROUP BY case_id) USING (case_id)""")  # fmt: skip
def _(spark, d):
    return packs(spark, d).select("case_id", "evidence_quality.*")


@query("case_ranks", "SELECT case_id, row_number() OVER (ORDER BY round(case_risk_score, 6) DESC, case_id) AS case_rank FROM {csc}")
def _(spark, d):
    return cq.scored_cases(spark, d)[4].select("case_id", F.col("case_rank").cast("long").alias("case_rank"))


@query("read_anomaly_bands", """
SELECT count(*) AS row_count, count(DISTINCT account_id) AS unique_account_count, max(anomaly_score) AS max_anomaly_score,
  count(*) FILTER (anomaly_score < 80) AS low_count, count(*) FILTER (anomaly_score >= 80 AND anomaly_score < 95) AS medium_count, count(*) FILTER (anomaly_score >= 95) AS high_count, 0 AS critical_count
FROM {an}""")  # fmt: skip
def _(spark, d):
    a = cq.anomalies(spark, d).withColumn("risk_band", anomaly_band(F.col("anomaly_score")))
    return read_api.mart_summary(a, "anomaly_score", bands="risk_band")


@query("read_newest_partition", """
SELECT o_orderkey, o_custkey FROM orders
WHERE (o_orderdate, o_orderpriority, o_orderstatus) = (SELECT (o_orderdate, o_orderpriority, o_orderstatus) FROM orders ORDER BY o_orderdate DESC, o_orderpriority DESC, o_orderstatus DESC LIMIT 1)""")  # fmt: skip
def _(spark, d):
    return read_api.newest_partition(tables.table(spark, d, "orders"), "o_orderdate", "o_orderpriority", "o_orderstatus").select("o_orderkey", "o_custkey")


@query("read_seed_accounts_of_case", """
SELECT c.case_id, account_id, round(s.account_risk_score, 4) AS account_risk_score
FROM (SELECT case_id, primary_account_id, account_ids FROM {cs} ORDER BY case_id LIMIT 1) c, {acc} a LEFT JOIN {score} s USING (account_id)
WHERE account_id = c.primary_account_id OR list_contains(c.account_ids, account_id)""")  # fmt: skip
def _(spark, d):
    made, _, scores = cq.made_cases(spark, d)
    made = checkpointed(made)
    case = made.agg(F.min("case_id")).first()[0]
    at = F.lit("2024-01-01")
    scores = scores.withColumns({"score_date": at, "scored_at": at})
    none = tables.event_accounts(spark, d).select("account_id", at.alias("feature_date"), at.alias("computed_at"), *[F.lit(None).cast("long").alias(c) for c in ("community_id", "community_size", "degree", "high_risk_alert_count")], F.lit(None).cast("double").alias("pagerank_score"))
    found = read_api.seed_accounts(tables.event_accounts(spark, d), scores, none, made, cases.case_entities(made), case_id=case)
    return found.select(F.lit(case).alias("case_id"), "account_id", cq.nearest("account_risk_score", 4).alias("account_risk_score"))


# lineage of what is bought: customers' orders of parts from suppliers, and nations, which customers lead back to
CTES["ln"] = """
SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation UNION SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier
UNION SELECT 'supplier:' || l_suppkey, 'order:' || l_orderkey FROM lineitem UNION SELECT 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer"""


def lineage_edges(spark, d) -> DataFrame:
    def pair(table, a, ac, b, bc):
        return tables.table(spark, d, table).select(F.concat(F.lit(a + ":"), F.col(ac).cast("string")).alias("src"), F.concat(F.lit(b + ":"), F.col(bc).cast("string")).alias("dst"))

    parts = [
        pair("nation", "region", "n_regionkey", "nation", "n_nationkey"), pair("supplier", "nation", "s_nationkey", "supplier", "s_suppkey"), pair("lineitem", "supplier", "l_suppkey", "order", "l_orderkey"),
        pair("orders", "order", "o_orderkey", "customer", "o_custkey"), pair("customer", "customer", "c_custkey", "nation", "c_nationkey"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


_WALK = """
WITH RECURSIVE e AS MATERIALIZED ({edges}), walk AS (
  SELECT 'region:' || r_regionkey AS start, 'region:' || r_regionkey AS node, 0 AS depth FROM region
  UNION SELECT w.start, e.dst, w.depth + 1 FROM walk w JOIN e ON e.src = w.node WHERE w.depth < {most}),
best AS (SELECT start, node, min(depth) AS depth FROM walk GROUP BY start, node)
SELECT start, split_part(node, ':', 1) AS kind, depth, count(*) AS nodes FROM best GROUP BY ALL"""


@query("govern_lineage_downstream")
def _(spark, d):
    starts = tables.table(spark, d, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("node_id"))
    found = security.reach(lineage_edges(spark, d), starts)
    return found.groupBy("start", F.substring_index("node", ":", 1).alias("kind"), "depth").agg(F.count("*").alias("nodes"))


@query("govern_lineage_upstream")
def _(spark, d):
    """What the nations of each region come from, at most three steps back: customers, orders, suppliers."""
    starts = tables.table(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("node_id"))
    found = security.reach(lineage_edges(spark, d), starts, downstream=False, most_depth=2)
    return found.groupBy("start", F.substring_index("node", ":", 1).alias("kind"), "depth").agg(F.count("*").alias("nodes"))


#: No way is longer than 8: nations, suppliers, orders, customers, nations, and once more.
SQL["govern_lineage_downstream"] = _WALK.format(edges=CTES["ln"], most=9)
SQL["govern_lineage_upstream"] = """
WITH e AS MATERIALIZED ({edges}), s AS (SELECT 'nation:' || n_nationkey AS start FROM nation),
one AS (SELECT DISTINCT start, e.src AS node FROM s JOIN e ON e.dst = start), two AS (SELECT DISTINCT start, e.src AS node FROM one JOIN e ON e.dst = one.node),
best AS (SELECT start, node, min(depth) AS depth FROM (SELECT start, start AS node, 0 AS depth FROM s UNION ALL SELECT start, node, 1 FROM one UNION ALL SELECT start, node, 2 FROM two) GROUP BY start, node)
SELECT start, split_part(node, ':', 1) AS kind, depth, count(*) AS nodes FROM best GROUP BY ALL""".format(edges=CTES["ln"])
