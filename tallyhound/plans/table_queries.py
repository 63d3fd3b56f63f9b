"""Queries of staging, gold tables, read API, lifecycle, labels, models, security."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhound.checkpoints import checkpointed
from tallyhound.functions import normalise as n
from tallyhound.operators import gold, graph, lifecycle, models, read_api, rules, security, staging
from tallyhound.plans import case_queries as cq
from tallyhound.plans.rule_queries import event_alerts
from tallyhound.plans.sql import CTES, compose
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


# staging: text as a feed might bring it, made from the test tables
def raw_customers(spark, d):
    c = tables.table(spark, d, "customer")
    key = F.col("c_custkey")
    again = F.explode(F.array(F.lit(0), F.lit(1))).alias("v")
    return c.select("*", again).select(
        F.concat(F.lit(" cust "), (key % 700).cast("string"), F.when(key % 3 == 0, " ").otherwise("")).alias("customer_id"), F.lower("c_mktsegment").alias("customer_segment"), F.when(key % 5 == 0, "NaN").when(key % 5 == 1, " High ").otherwise(None).alias("customer_risk_rating"),
        F.when(key % 4 == 0, "oops").otherwise((key * 3 % 170 - 20).cast("string")).alias("customer_risk_score"), F.when(key % 6 == 0, "null").otherwise(F.concat(F.lit("c"), F.col("c_nationkey").cast("string"))).alias("jurisdiction"), (key * 2 + F.col("v")).alias("raw_record_id"), F.col("v").alias("ingested_at"),
    )


CTES["rawc"] = "SELECT 'CUST_' || (c_custkey % 700) AS customer_id, c_mktsegment AS seg, CASE WHEN c_custkey % 5 = 1 THEN 'high' ELSE 'low' END AS rating, CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE greatest(0, least(100, c_custkey * 3 % 170 - 20)) END AS score, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'C' || c_nationkey END AS jurisdiction, c_custkey * 2 + v AS id, v FROM customer, (SELECT unnest([0, 1]) AS v)"


@query("stage_customers", "SELECT customer_id, lower(seg) AS customer_segment, rating AS customer_risk_rating, score::DOUBLE AS customer_risk_score, jurisdiction FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY v DESC, id DESC) AS k FROM {rawc}) WHERE k = 1")
def _(spark, d):
    return staging.customers(raw_customers(spark, d)).select("customer_id", "customer_segment", "customer_risk_rating", "customer_risk_score", "jurisdiction")


@query("stage_transactions", "SELECT transaction_id, sender_account_id, receiver_account_id, amount, transaction_type, origin_country, CASE WHEN destination_country = 'C3' THEN NULL ELSE destination_country END AS destination_country, coalesce(origin_country <> CASE WHEN destination_country = 'C3' THEN NULL ELSE destination_country END, false) AS is_cross_border, currency FROM (SELECT *, CASE WHEN device_id = 'DEV_7' THEN 'USD' ELSE 'EUR' END AS currency FROM {tx}) WHERE counterparty_id <> 'CP_5' AND amount > 0")
def _(spark, d):
    t = tables.event_transactions(spark, d)
    raw = t.select(
        F.concat(F.lit(" "), F.lower("transaction_id")).alias("transaction_id"), F.lower("sender_account_id").alias("sender_account_id"), F.coalesce(F.lower("receiver_account_id"), F.lit("<NA>")).alias("receiver_account_id"), "counterparty_id", F.col("transaction_timestamp").cast("string").alias("transaction_timestamp"),
        F.when(F.col("counterparty_id") == "CP_5", "n/a").otherwise(F.col("amount").cast("string")).alias("amount"), F.when(F.col("device_id") == "DEV_7", "").otherwise(" eur ").alias("currency"), F.upper("transaction_type").alias("transaction_type"), "origin_country", F.when(F.col("destination_country") == "C3", "None").otherwise(F.col("destination_country")).alias("destination_country"),
    )
    return staging.transactions(raw).select("transaction_id", "sender_account_id", "receiver_account_id", "amount", "transaction_type", "origin_country", "destination_country", "is_cross_border", "currency")


@query("stage_countries", "SELECT 'C' || n_nationkey AS country_code, n_name AS country_name, n_nationkey % 6 = 0 AS is_high_risk, coalesce(CASE WHEN n_nationkey % 7 <> 3 THEN n_nationkey * 4 % 101 END, 0)::DOUBLE AS risk_score FROM nation")
def _(spark, d):
    raw = tables.countries(spark, d).select(F.lower("country_code").alias("country_code"), "country_name", F.when(F.col("is_high_risk"), " Yes").otherwise("0").alias("is_high_risk"), F.col("risk_score").cast("string").alias("risk_score"))
    return staging.countries(raw).select("country_code", "country_name", "is_high_risk", "risk_score")


@query("stage_accounts", "SELECT account_id, customer_id, CASE WHEN account_status = 'closed' THEN 'closed' ELSE 'active' END AS account_status, home_country FROM {acc} WHERE customer_id <> 'CUST_3'")
def _(spark, d):
    a = tables.event_accounts(spark, d)
    raw = a.select(F.concat(F.lower("account_id"), F.lit("  ")).alias("account_id"), F.when(F.col("customer_id") == "CUST_3", " nan").otherwise(F.col("customer_id")).alias("customer_id"), F.when(F.col("account_status") == "closed", "Closed").alias("account_status"), F.lower("home_country").alias("home_country"))
    return staging.accounts(raw).select("account_id", "customer_id", "account_status", "home_country")


@query("stage_raw_records")
def _(spark, d):
    return staging.raw_records(tables.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "bank", "nation.parquet", "nation").select("table_name", "payload", "record_hash")


_PAYLOAD = """'{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}'"""
SQL["stage_raw_records"] = f"SELECT 'nation' AS table_name, {_PAYLOAD} AS payload, sha256({_PAYLOAD}) AS record_hash FROM nation"


@query("stage_expand_payload", "SELECT n_nationkey, n_name, 'nation' AS table_name FROM nation")
def _(spark, d):
    raw = staging.raw_records(tables.table(spark, d, "nation"), "bank", "nation.parquet", "nation")
    return staging.expand_payload(raw, "n_nationkey int, n_name string").select("n_nationkey", "n_name", "table_name")


@query("stage_upsert", "SELECT account_id, CASE WHEN home_country = 'C1' THEN 'frozen' ELSE account_status END AS account_status FROM {acc}")
def _(spark, d):
    a = tables.event_accounts(spark, d).select("account_id", "account_status", "home_country")
    fresh = a.filter("home_country = 'C1'").withColumn("account_status", F.lit("frozen"))
    return staging.upsert(a, fresh, ["account_id"]).select("account_id", "account_status")


@query("stage_insert_missing", "SELECT account_id FROM {acc}")
def _(spark, d):
    a = tables.event_accounts(spark, d).select("account_id", "home_country")
    return staging.insert_missing(a.filter("home_country <> 'C1'"), a, ["account_id"]).select("account_id")


@query("stage_orphans", "SELECT DISTINCT receiver_account_id AS value FROM {tx} WHERE receiver_account_id IS NOT NULL AND receiver_account_id NOT IN (SELECT account_id FROM {acc} WHERE home_country <> 'C2')")
def _(spark, d):
    return staging.orphans(tables.event_transactions(spark, d), "receiver_account_id", tables.event_accounts(spark, d).filter("home_country <> 'C2'"), "account_id")


@query("stage_integrity", "SELECT 'duplicate_accounts' AS check_name, 0 AS violations UNION ALL SELECT 'duplicate_transactions', 0 UNION ALL SELECT 'orphan_transactions_sender_account_id', count(DISTINCT sender_account_id) FILTER (origin_country = 'C2') FROM {tx} UNION ALL SELECT 'orphan_transactions_receiver_account_id', count(DISTINCT receiver_account_id) FROM {tx} WHERE receiver_account_id NOT IN (SELECT account_id FROM {acc} WHERE home_country <> 'C2') UNION ALL SELECT 'amount_not_positive', count(*) FILTER (amount <= 0) FROM {tx} UNION ALL SELECT 'cross_border_flag', 0")
def _(spark, d):
    return staging.integrity({"accounts": tables.event_accounts(spark, d).filter("home_country <> 'C2'"), "transactions": tables.event_transactions(spark, d)})


@query("stage_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return staging.duplicates(tables.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies"))


@query("scalar_normalisers", "SELECT n_nationkey, upper(n_name) AS country, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'ID_' || n_nationkey END AS identifier, n_nationkey % 2 = 0 AS flag, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey + 0.5 END::DOUBLE AS number, array_to_string(list_sort(list_distinct([n_name, 'X'])), '|') AS ids FROM nation")
def _(spark, d):
    t = tables.table(spark, d, "nation")
    k = F.col("n_nationkey")
    raw = t.select(k, F.concat(F.lit(" "), F.lower("n_name")).alias("c"), F.when(k % 3 == 0, " NaT ").otherwise(F.concat(F.lit("id \t "), k.cast("string"))).alias("i"), F.when(k % 2 == 0, " TRUE").otherwise("maybe").alias("b"), F.when(k % 5 == 0, "x1").otherwise(F.concat(k.cast("string"), F.lit(".5"))).alias("f"), F.concat(F.lit('["X", "'), F.col("n_name"), F.lit('", " X "]')).alias("l"))
    return raw.select("n_nationkey", n.country(F.col("c")).alias("country"), n.identifier(F.col("i")).alias("identifier"), n.boolean(F.col("b")).alias("flag"), n.number(F.col("f")).alias("number"), F.array_join(n.id_list(F.col("l")), "|").alias("ids"))


# gold
CTES["gx"] = "SELECT DISTINCT account_id FROM {al_st}"
CTES["gs"] = "SELECT sender_account_id AS account_id, count(*) AS n, sum(amount)::DOUBLE AS total, avg(amount)::DOUBLE AS av, max(amount)::DOUBLE AS mx, count(DISTINCT receiver_account_id) + max(CASE WHEN receiver_account_id IS NULL THEN 1 ELSE 0 END) AS others FROM {tx} GROUP BY 1"
CTES["gr"] = "SELECT receiver_account_id AS account_id, count(*) AS n, sum(amount)::DOUBLE AS total, avg(amount)::DOUBLE AS av, max(amount)::DOUBLE AS mx FROM {tx} WHERE receiver_account_id IS NOT NULL GROUP BY 1"
CTES["gfeat"] = "SELECT a.account_id, coalesce(s.n, 0) + coalesce(r.n, 0) AS txn_count_total, coalesce(s.total, 0) AS st, coalesce(r.total, 0) AS rt, coalesce(s.av, 0) AS sa, coalesce(r.av, 0) AS ra, coalesce(s.mx, 0) AS sm, coalesce(r.mx, 0) AS rm, coalesce(s.others, 0) AS others FROM {acc} a LEFT JOIN {gs} s USING (account_id) LEFT JOIN {gr} r USING (account_id)"
CTES["ggr"] = "SELECT a.account_id, coalesce(s.n, 0) AS out_degree, coalesce(r.n, 0) AS in_degree, coalesce(s.n, 0) + coalesce(r.n, 0) AS degree_total FROM {acc} a LEFT JOIN {gs} s USING (account_id) LEFT JOIN {gr} r USING (account_id)"
_HEX = "CAST(('0x' || substr(sha256(account_id), 1, 8)) AS BIGINT)"
CTES["gan"] = f"SELECT account_id, round(txn_count_total / m * 45.0 + CASE WHEN account_id IN (SELECT account_id FROM {{gx}}) THEN 45.0 ELSE 0.0 END + {_HEX} % 10, 2) AS anomaly_score FROM {{gfeat}}, (SELECT greatest(max(txn_count_total), 1) AS m FROM {{gfeat}})"


def gold_band_sql(x: str) -> str:
    return f"CASE WHEN {x} >= 90 THEN 'critical' WHEN {x} >= 70 THEN 'high' WHEN {x} >= 40 THEN 'medium' ELSE 'low' END"


CTES["gar0"] = "SELECT a.account_id, anomaly_score AS anomaly_component, round(degree_total / m * 100, 2) AS graph_risk_component, CASE WHEN a.account_id IN (SELECT account_id FROM {gx}) THEN 85.0 ELSE 15.0 END::DOUBLE AS rule_risk_component FROM {gan} a JOIN {ggr} g USING (account_id), (SELECT greatest(max(degree_total), 1) AS m FROM {ggr})"
CTES["gar"] = "SELECT *, round(anomaly_component * 0.4 + graph_risk_component * 0.25 + rule_risk_component * 0.35, 2) AS account_risk_score FROM {gar0}"


def flagged(spark, d):
    t, a = tables.event_transactions(spark, d), tables.event_accounts(spark, d)
    from tallyhound.plans.rule_queries import STRUCTURING

    return checkpointed(rules.structuring_alerts(t, a, STRUCTURING).select("account_id").distinct())


def _gold_features(spark, d):
    return gold.features(tables.event_accounts(spark, d), tables.event_transactions(spark, d))


@query("gold_features", "SELECT account_id, txn_count_total, round(txn_count_total / 13.0, 2)::DOUBLE AS txn_count_1d, round(st * (7.0::DOUBLE / 90.0), 2) AS total_sent_7d, round(CASE WHEN sa > 0 THEN sa ELSE ra END, 2) AS avg_txn_amount_30d, greatest(sm, rm) AS max_txn_amount_30d, others AS unique_counterparties_7d, round(CASE WHEN rt > 0 THEN st / rt ELSE 999999.0 END, 4) AS in_out_ratio_7d, round(rt - st, 2) AS retained_balance_proxy FROM {gfeat}")
def _(spark, d):
    return _gold_features(spark, d).drop("txn_count_7d", "total_received_7d")


@query("gold_graph_features", "SELECT account_id, out_degree, in_degree, degree_total, round(degree_total / m, 6) AS degree_share FROM {ggr}, (SELECT greatest(max(degree_total), 1) AS m FROM {ggr})")
def _(spark, d):
    return gold.graph_features(tables.event_accounts(spark, d), tables.event_transactions(spark, d))


@query("gold_anomaly_scores", f"SELECT account_id, anomaly_score, anomaly_score >= 70 AS is_anomaly, {gold_band_sql('anomaly_score')} AS risk_band, row_number() OVER (ORDER BY anomaly_score DESC, account_id) AS anomaly_rank FROM {{gan}}")
def _(spark, d):
    return gold.anomaly_scores(_gold_features(spark, d), flagged(spark, d))


def _gold_risk(spark, d):
    a, t, f = tables.event_accounts(spark, d), tables.event_transactions(spark, d), flagged(spark, d)
    return gold.account_risk(gold.anomaly_scores(gold.features(a, t), f), gold.graph_features(a, t), f)


@query("gold_account_risk", f"SELECT account_id, anomaly_component, graph_risk_component, rule_risk_component, account_risk_score, {gold_band_sql('account_risk_score')} AS risk_band, row_number() OVER (ORDER BY account_risk_score DESC, account_id) AS risk_rank FROM {{gar}}")
def _(spark, d):
    return _gold_risk(spark, d)


CTES["gcs"] = "SELECT account_id, sum(n) AS alert_count, count(*) AS typology_count, (min(struct_pack(a := -n, b := -r, c := typology))).c AS main_typology, max(mx) AS max_alert_score, sum(sm) / sum(n) AS mean_alert_score, 'CASE_' || upper(substr(sha1(account_id), 1, 10)) AS case_id FROM (SELECT account_id, typology, count(*) AS n, 3 AS r, max(risk_score_rule) AS mx, sum(risk_score_rule) AS sm FROM {al} GROUP BY ALL) GROUP BY account_id"


@query("gold_cases", f"SELECT account_id, alert_count, typology_count, main_typology, max_alert_score, round(mean_alert_score, 6) AS mean_alert_score, case_id, 'analyst_' || ({_HEX} % 5 + 1) AS assigned_to FROM {{gcs}}")
def _(spark, d):
    return gold.cases(event_alerts(spark, d)).withColumn("mean_alert_score", F.round("mean_alert_score", 6)).drop("status")


@query("gold_case_risk", f"SELECT case_id, round(s + 1e-9, 2) AS case_risk_score, {gold_band_sql('round(s + 1e-9, 2)')} AS risk_band FROM (SELECT case_id, max_alert_score * 0.5 + coalesce(account_risk_score, 0) * 0.3 + typology_count * 5.0 + alert_count * 1.5 AS s FROM {{gcs}} LEFT JOIN {{gar}} USING (account_id))")
def _(spark, d):
    return gold.case_risk(gold.cases(event_alerts(spark, d)), _gold_risk(spark, d)).select("case_id", "case_risk_score", "risk_band")


@query("gold_alerts_from_manifest", "SELECT 'AL_' || upper(substr(sha1('SC_' || c_custkey), 1, 10)) AS alert_id, 'A' || c_custkey AS account_id, 'high' AS severity, 75.0::DOUBLE AS risk_score_rule, 2 AS evidence_count FROM customer")
def _(spark, d):
    m = tables.table(spark, d, "customer").select(F.concat(F.lit("SC_"), F.col("c_custkey").cast("string")).alias("scenario_id"), F.lit("fan_in").alias("typology"), F.concat(F.lit("A"), F.col("c_custkey").cast("string")).alias("primary_account_id"), F.lit("T1, T2").alias("evidence_transaction_ids"), F.lit("High").alias("expected_severity"))
    return gold.alerts_from_manifest(m).select("alert_id", "account_id", "severity", "risk_score_rule", "evidence_count")


# read API
@query("read_alert_queue", "SELECT alert_id, account_id, risk_score_rule FROM {al} WHERE typology IN ('fan_in', 'fan_out') AND contains(lower(account_id), 'acc_1') ORDER BY risk_score_rule DESC, alert_id LIMIT 20")
def _(spark, d):
    return read_api.alert_queue(event_alerts(spark, d), typologies=["fan_in", "", "fan_out"], account="ACC_1", limit=20).select("alert_id", "account_id", "risk_score_rule")


@query("read_text_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'a') AND (contains(lower(p_brand), '1') OR contains(lower(p_type), '1'))")
def _(spark, d):
    return read_api.contains_any(read_api.contains_any(tables.table(spark, d, "part"), "A ", ["p_name"]), "1", ["p_brand", "p_type"]).select("p_partkey")


@query("read_value_counts", "SELECT typology AS value, count(*) AS n FROM {al} GROUP BY typology")
def _(spark, d):
    return read_api.value_counts(event_alerts(spark, d), "typology")


@query("read_filter_options", "SELECT DISTINCT 'account_status' AS \"column\", account_status AS value FROM {acc} UNION ALL SELECT DISTINCT 'customer_risk_rating', customer_risk_rating FROM {acc}")
def _(spark, d):
    return read_api.filter_options(tables.event_accounts(spark, d), ["account_status", "customer_risk_rating"])


@query("read_overview", "SELECT 'accounts' AS table_name, count(*) AS rows FROM {acc} UNION ALL SELECT 'transactions', count(*) FROM {tx}")
def _(spark, d):
    return read_api.overview(accounts=tables.event_accounts(spark, d), transactions=tables.event_transactions(spark, d))


@query("read_latest_orders", "SELECT o_orderkey FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def _(spark, d):
    return read_api.read(tables.table(spark, d, "orders"), latest_on="o_orderdate").select("o_orderkey")


@query("read_account_summary", "SELECT count(*) AS transaction_count, sum(CASE WHEN sender_account_id = 'ACC_3' THEN amount ELSE 0 END) AS total_sent, sum(CASE WHEN receiver_account_id = 'ACC_3' THEN amount ELSE 0 END) AS total_received, max(amount) AS max_amount, count(DISTINCT counterparty_id) AS counterparty_count FROM {tx} WHERE sender_account_id = 'ACC_3' OR receiver_account_id = 'ACC_3'")
def _(spark, d):
    return read_api.account_summary(tables.event_transactions(spark, d), "ACC_3")


@query("read_counterparty_rollup", "SELECT CASE WHEN sender_account_id = 'ACC_3' THEN coalesce(receiver_account_id, counterparty_id) ELSE sender_account_id END AS other, count(*) AS transaction_count, sum(amount) AS total_amount FROM {tx} WHERE sender_account_id = 'ACC_3' OR receiver_account_id = 'ACC_3' GROUP BY 1")
def _(spark, d):
    return read_api.counterparty_rollup(tables.event_transactions(spark, d), "ACC_3").drop("last_at")


@query("read_case_queue", "SELECT case_id, priority_score, 'New' AS status FROM {cs} ORDER BY priority_score DESC, case_id LIMIT 10")
def _(spark, d):
    made = checkpointed(cq.made_cases(spark, d)[0])
    none = made.select("case_id", F.lit(None).cast("double").alias("case_risk_score"), F.lit(None).cast("string").alias("risk_band"))
    return read_api.case_queue(made, none, statuses=["New"], limit=10).select("case_id", "priority_score", "status")


@query("read_linked_cases", "SELECT DISTINCT case_id FROM {cs} WHERE primary_account_id = 'ACC_3' OR list_contains(account_ids, 'ACC_3')")
def _(spark, d):
    from tallyhound.operators import cases

    made = checkpointed(cq.made_cases(spark, d)[0])
    return read_api.linked_cases(made, cases.case_entities(made), "ACC_3")


@query("read_top_ranked", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def _(spark, d):
    return read_api.top_ranked(tables.table(spark, d, "customer"), "c_acctbal", "c_custkey").select("c_custkey", "c_acctbal")


@query("read_graph_view", "SELECT src, dst FROM {sg} WHERE src IN (SELECT id FROM (SELECT account_id AS id FROM {acc} ORDER BY CAST(substr(account_id, 5) AS BIGINT) DESC, account_id LIMIT 12)) AND dst IN (SELECT id FROM (SELECT account_id AS id FROM {acc} ORDER BY CAST(substr(account_id, 5) AS BIGINT) DESC, account_id LIMIT 12)) ORDER BY src, dst LIMIT 500")
def _(spark, d):
    nodes = tables.event_accounts(spark, d).select(F.col("account_id").alias("id"), F.substring("account_id", 5, 20).cast("long").alias("score"))
    edges = graph.flow_edges(tables.event_transactions(spark, d)).filter("dst_label = 'Account'").select("src", "dst").distinct()
    return read_api.graph_view(nodes, edges, 12)[1]


@query("read_node_sizes", "SELECT c_custkey, round(12 + greatest(0, least(100, c_acctbal)) / 100 * 30, 6) AS node_size FROM customer")
def _(spark, d):
    return read_api.node_sizes(tables.table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", F.round("node_size", 6).alias("node_size"))


# lifecycle and labels: events of orders as cases
CTES["lc"] = "SELECT 'CASE_' || o_custkey AS case_id, o_orderkey AS k, o_orderdate AS happened, ['In review', 'Escalated', 'Closed suspicious', 'Closed false positive', 'Information requested'][o_orderkey % 5 + 1] AS to_status FROM orders"


def lifecycle_events(spark, d):
    k = F.col("o_orderkey")
    to = F.element_at(F.array(*[F.lit(s) for s in ("In review", "Escalated", "Closed suspicious", "Closed false positive", "Information requested")]), (k % 5 + 1).cast("int"))
    return tables.table(spark, d, "orders").select(F.concat(F.lit("CASE_"), F.col("o_custkey").cast("string")).alias("case_id"), F.lpad(k.cast("string"), 12, "0").alias("action_id"), F.lit("status_change").alias("action_type"), F.lit("New").alias("from_status"), to.alias("to_status"), F.lit("ana").alias("analyst_id"), F.when(k % 2 == 0, "reason").alias("decision_reason"), F.when(k % 3 == 0, "comment").alias("comment"), F.col("o_orderdate").cast("timestamp_ntz").alias("action_timestamp"))


@query("lifecycle_current_state", "SELECT case_id, (max(struct_pack(a := happened, k := k, s := to_status))).s AS status, count(*) AS events FROM {lc} GROUP BY case_id")
def _(spark, d):
    return lifecycle.current_state(lifecycle_events(spark, d)).select("case_id", "status", "events")


@query("lifecycle_invalid_actions", "SELECT k FROM {lc} WHERE to_status LIKE 'Closed%' AND (k % 2 <> 0 OR k % 3 <> 0)")
def _(spark, d):
    return lifecycle.invalid_actions(lifecycle_events(spark, d)).select(F.col("action_id").cast("long").alias("k"))


@query("lifecycle_summary", "SELECT count(*) AS events, count(DISTINCT case_id) AS cases, 1 AS analysts, count(*) FILTER (to_status LIKE 'Closed%') AS closures FROM {lc}")
def _(spark, d):
    return lifecycle.lifecycle_summary(lifecycle_events(spark, d))


CTES["lb"] = "SELECT case_id, (max(struct_pack(a := happened, k := k, s := to_status))) AS m FROM {lc} WHERE to_status IN ('Closed suspicious', 'Escalated', 'Closed false positive') GROUP BY case_id"
CTES["lbl"] = "SELECT case_id, m.s AS label_status, CASE WHEN m.s = 'Closed false positive' THEN 0 ELSE 1 END AS label, m.a AS happened FROM {lb}"


def _labels(spark, d):
    e = lifecycle_events(spark, d)
    cases = e.select("case_id").distinct().withColumn("primary_account_id", F.concat(F.lit("A"), (F.substring("case_id", 6, 20).cast("long") % 100).cast("string")))
    return lifecycle.case_labels(cases, e)


@query("label_cases", "SELECT case_id, label_status, label FROM {lbl}")
def _(spark, d):
    return _labels(spark, d).select("case_id", "label_status", "label")


@query("label_accounts", "SELECT 'A' || (CAST(substr(case_id, 6) AS BIGINT) % 100) AS account_id, max(label) AS label, count(*) AS case_count FROM {lbl} GROUP BY 1")
def _(spark, d):
    none = spark.createDataFrame([], "case_id string, entity_type string, entity_id string")
    return lifecycle.account_labels(_labels(spark, d), none).select("account_id", "label", "case_count")


@query("label_supervised_dataset", "SELECT case_id, label, c_acctbal FROM {lbl} LEFT JOIN customer ON 'CASE_' || c_custkey = case_id")
def _(spark, d):
    f = tables.table(spark, d, "customer").select(F.concat(F.lit("CASE_"), F.col("c_custkey").cast("string")).alias("case_id"), "c_acctbal")
    return lifecycle.supervised_dataset(_labels(spark, d).select("case_id", "label"), "case_id", (f, None))


# models
CTES["sc"] = "SELECT o_orderkey AS id, (o_orderkey % 97) / 97.0::DOUBLE AS score, CASE WHEN (o_orderkey * 7 + o_custkey) % 5 < 2 THEN 1 ELSE 0 END AS label FROM orders"


def _scored(spark, d):
    k = F.col("o_orderkey")
    return tables.table(spark, d, "orders").select(k.alias("id"), ((k % 97) / 97).alias("score"), F.when((k * 7 + F.col("o_custkey")) % 5 < 2, 1).otherwise(0).alias("label"))


@query("model_threshold_metrics", "SELECT t AS threshold, count(*) AS row_count, count(*) FILTER (score >= t AND label = 1) AS true_positive, count(*) FILTER (score >= t AND label = 0) AS false_positive, round((count(*) FILTER ((score >= t) = (label = 1))) / count(*), 6) AS accuracy FROM {sc}, (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS t) GROUP BY t")
def _(spark, d):
    return models.threshold_metrics(_scored(spark, d), [0.25, 0.5, 0.75]).select("threshold", "row_count", "true_positive", "false_positive", F.round("accuracy", 6).alias("accuracy"))


@query("model_curve_metrics", "SELECT round(sum(CASE WHEN label = 1 THEN r END - 0.0) / any_value(np) / any_value(nn) - (any_value(np) + 1) / 2.0 / any_value(nn), 6) AS roc_auc FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r, sum(label) OVER () AS np, sum(1 - label) OVER () AS nn FROM {sc})")
def _(spark, d):
    return models.curve_metrics(_scored(spark, d)).select(F.round("roc_auc", 6).alias("roc_auc"))


@query("model_average_precision", "SELECT round(sum(p / tp * cp / cn), 6) AS pr_auc FROM (SELECT p, sum(p) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn, sum(p) OVER () AS tp FROM (SELECT score, sum(label)::DOUBLE AS p, count(*) AS n FROM {sc} GROUP BY score))")
def _(spark, d):
    return models.curve_metrics(_scored(spark, d)).select(F.round("pr_auc", 6).alias("pr_auc"))


@query("model_precision_at_k", "SELECT k AS top_k, count(*) AS row_count, sum(label) AS positive_count, round(sum(label) / count(*), 6) AS precision_at_k, round(sum(label) / any_value(np), 6) AS recall_at_k FROM (SELECT label, row_number() OVER (ORDER BY score DESC, id) AS r, sum(label) OVER () AS np FROM {sc}), (SELECT unnest([10, 50, 100]) AS k) WHERE r <= k GROUP BY k")
def _(spark, d):
    return models.at_k(_scored(spark, d), [10, 50, 100], "id").withColumns({c: F.round(c, 6) for c in ("precision_at_k", "recall_at_k")})


@query("model_preprocessing", "SELECT c_custkey, round((c_acctbal - m) / s, 6) AS c_acctbal FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer)")
def _(spark, d):
    c = tables.table(spark, d, "customer").select("c_custkey", "c_acctbal")
    p = models.Preprocessing(("c_acctbal",))
    return models.apply_preprocessing(c, models.fit_preprocessing(c, p)).withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("model_robust_preprocessing", "SELECT c_custkey, round((coalesce(x, m0) - m) / (q3 - q1), 6) AS x FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS x FROM customer), (SELECT median(c_acctbal) AS m0 FROM customer WHERE c_custkey % 7 <> 0), (SELECT quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS m, quantile_cont(y, 0.75) AS q3 FROM (SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal ELSE (SELECT median(c_acctbal) FROM customer WHERE c_custkey % 7 <> 0) END AS y FROM customer))")
def _(spark, d):
    c = tables.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("x"))
    p = models.Preprocessing(("x",), scale="robust")
    return models.apply_preprocessing(c, models.fit_preprocessing(c, p)).withColumn("x", F.round("x", 6))


@query("model_isolation_forest")
def _(spark, d):
    c = tables.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("account_id"), "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"))
    return models.isolation_forest(c, ("c_acctbal", "c_nationkey"))


@query("model_supervised_scores")
def _(spark, d):
    f = tables.table(spark, d, "customer").select(F.concat(F.lit("CASE_"), F.col("c_custkey").cast("string")).alias("case_id"), "c_acctbal", "c_nationkey")
    ds = checkpointed(lifecycle.supervised_dataset(_labels(spark, d).select("case_id", "label", "label_timestamp"), "case_id", (f, None)))
    split = models.split_by_time(ds, "label_timestamp", "case_id")
    use = models.usable_features(split.filter("NOT is_validation"), ["c_acctbal", "c_nationkey"])
    return models.score_supervised(models.train_supervised(split.filter("NOT is_validation"), use), split.filter("is_validation"), use, "case_id")


# security and governance
#: The rights of each role, as the permission matrix should have them.
_RIGHTS = """
SELECT role, action, role = 'admin' OR list_contains(string_split(rights, ','), action) AS allowed, list_contains(['case_close', 'case_archive', 'export_sensitive', 'read_audit_log', 'read_governance_inventory'], action) AS protected
FROM (VALUES ('viewer', 'read_dashboard,export_sanitised,read_validation_reports'), ('analyst', 'read_dashboard,export_sanitised,read_validation_reports,case_comment,case_assign,case_status_change'),
  ('senior_analyst', 'read_dashboard,export_sanitised,export_sensitive,read_validation_reports,case_comment,case_assign,case_status_change,case_close,case_archive'),
  ('governance_reviewer', 'read_dashboard,export_sanitised,read_validation_reports,read_audit_log,read_governance_inventory'), ('admin', '*')) AS r(role, rights),
(SELECT unnest(['*', 'read_dashboard', 'export_sanitised', 'export_sensitive', 'read_validation_reports', 'case_comment', 'case_assign', 'case_status_change', 'case_close', 'case_archive', 'read_audit_log', 'read_governance_inventory']) AS action)"""
_ROLE_OF = "['viewer', 'analyst', 'senior_analyst', 'governance_reviewer', 'admin'][c_custkey % 5 + 1]"
SQL["secure_permission_matrix"] = f"SELECT m.*, users FROM ({_RIGHTS}) m JOIN (SELECT {_ROLE_OF} AS role, count(*) AS users FROM customer GROUP BY 1) u USING (role)"


@query("secure_mask_frame", "SELECT c_custkey, '[REDACTED]' AS c_name, sha256('s|' || c_mktsegment) AS c_mktsegment, '****' || right(c_nationkey::VARCHAR, 4) AS c_nationkey FROM customer")
def _(spark, d):
    c = tables.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return security.mask_frame(c, {"c_name": "redact", "c_mktsegment": "hash", "c_nationkey": "preserve_last_4", "c_custkey": "none"}, "s")


@query("secure_export", "SELECT sha256('local_dev_salt|' || account_id) AS account_id, sha256('local_dev_salt|' || customer_id) AS customer_id, account_status FROM {acc}")
def _(spark, d):
    return security.export(tables.event_accounts(spark, d).select("account_id", "customer_id", "account_status", F.col("home_country").alias("token")), "viewer", most_rows=None)


@query("secure_permission_matrix")
def _(spark, d):
    """What the customers, as users of five roles, may do: a row a role and action, with its users."""
    roles = F.array(*[F.lit(r) for r in ("viewer", "analyst", "senior_analyst", "governance_reviewer", "admin")])
    users = tables.table(spark, d, "customer").groupBy(F.element_at(roles, (F.col("c_custkey") % 5 + 1).cast("int")).alias("role")).agg(F.count("*").alias("users"))
    return users.join(F.broadcast(security.permission_matrix(spark)), "role")


@query("secure_audit_checks", "SELECT 'required_columns' AS check_name, 'fail' AS status, 1 AS issue_count, 'high' AS severity UNION ALL SELECT 'status_values', CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END, n, CASE WHEN n > 0 THEN 'medium' ELSE 'info' END FROM (SELECT count(DISTINCT event_type) AS n FROM events WHERE event_type <> 'error') UNION ALL SELECT 'duplicate_events', CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END, n, CASE WHEN n > 0 THEN 'medium' ELSE 'info' END FROM (SELECT coalesce(sum(c), 0)::BIGINT AS n FROM (SELECT count(*) AS c FROM events GROUP BY event_type, user_id, CAST(ts AS DATE) HAVING count(*) > 1))")
def _(spark, d):
    status = F.when(F.col("event_type") == "error", "Failed").otherwise(F.col("event_type"))
    e = tables.table(spark, d, "events").select("event_type", F.col("user_id").alias("component"), status.alias("status"), F.col("ts").cast("date").alias("created_at"))
    return security.audit_checks(e)


@query("govern_lineage", "SELECT 'table:tx' AS src, 'process:rules' AS dst, 'reads' AS edge_type UNION ALL SELECT 'process:rules', 'table:alerts', 'writes' UNION ALL SELECT 'process:rules', 'run:' || r_regionkey, 'ran' FROM region")
def _(spark, d):
    runs = tables.table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("run_id"), F.lit("rules").alias("process"))
    return security.lineage(spark, {"tx": 1, "alerts": 2}, {"rules": (["tx"], ["alerts"])}, runs)[1]


@query("govern_inventory", "SELECT DISTINCT 'brand' AS kind, p_brand AS name, p_size::VARCHAR AS version FROM part UNION ALL SELECT DISTINCT 'segment', c_mktsegment, c_nationkey::VARCHAR FROM customer")
def _(spark, d):
    return security.inventory(brand=(tables.table(spark, d, "part"), "p_brand", "p_size"), segment=(tables.table(spark, d, "customer"), "c_mktsegment", "c_nationkey"))


@query("govern_sensitive_fields", """
SELECT t.*, CASE column_name WHEN 'email_address' THEN (SELECT count(*) FROM {acc} WHERE account_status = 'active') ELSE (SELECT count(*) FROM {acc}) END AS filled_rows
FROM (VALUES ('account', 'account_id', 'confidential', 'account_id', 'hash'), ('account', 'account_status', 'internal', NULL, 'none'), ('account', 'customer_id', 'confidential', 'customer_id', 'hash'),
  ('account', 'email_address', 'restricted', 'email', 'redact'), ('account', 'owner_tax_id', 'restricted', 'tax_id', 'redact')) AS t(table_name, column_name, classification, matched_pattern, recommended_masking_strategy)""")  # fmt: skip
def _(spark, d):
    """Accounts with two more columns; each column's class, and how many rows have a value in it."""
    mail = F.when(F.col("account_status") == "active", F.concat("account_id", F.lit("@mail")))
    a = tables.event_accounts(spark, d).select("account_id", "account_status", "customer_id", mail.alias("email_address"), F.col("customer_id").alias("owner_tax_id"))
    return F.broadcast(security.sensitive_fields(spark, {"account": a.columns})).join(security.filled_columns(a), "column_name")


@query("join_alerts_to_accounts", "SELECT l.alert_id, a.account_status FROM {al} l LEFT JOIN {acc} a ON l.account_id = a.account_id")
def _(spark, d):
    return event_alerts(spark, d).join(tables.event_accounts(spark, d).select("account_id", "account_status"), "account_id", "left").select("alert_id", "account_status")


