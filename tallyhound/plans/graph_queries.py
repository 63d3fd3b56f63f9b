"""Queries of account features and graph features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhound.operators import features, graph, rules
from tallyhound.operators.projection import RELATIONSHIPS
from tallyhound.plans.rule_queries import CONFIGS, STRUCTURING
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


CTES["wgt"] = "SELECT country_code, greatest(0, least(1, coalesce(risk_score / 100, CASE WHEN is_high_risk THEN 1.0 ELSE 0.0 END))) AS weight FROM {ctry}"
CTES["txw"] = "SELECT t.*, coalesce(receiver_account_id, counterparty_id) AS recipient_key, greatest(coalesce(o.weight, 0), coalesce(d.weight, 0)) AS weight FROM {tx} t LEFT JOIN {wgt} o ON t.origin_country = o.country_code LEFT JOIN {wgt} d ON t.destination_country = d.country_code"
CTES["mv"] = """
SELECT a AS account_id, transaction_id, transaction_timestamp AS ts, amount, CASE WHEN a = sender_account_id THEN amount END AS sent, CASE WHEN a = receiver_account_id THEN amount END AS received,
  CASE WHEN a = sender_account_id THEN recipient_key END AS out_key, CASE WHEN a = receiver_account_id THEN sender_account_id END AS in_key, is_cross_border, weight
FROM (SELECT *, sender_account_id AS a FROM {txw} UNION ALL SELECT *, receiver_account_id FROM {txw} WHERE receiver_account_id IS NOT NULL AND receiver_account_id <> sender_account_id)"""
CTES["spine"] = "SELECT CAST(unnest(range(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE) + 1, INTERVAL 1 DAY)) AS DATE) AS feature_date FROM events"
CTES["mvd"] = "SELECT m.*, d.feature_date, m.ts > d.feature_date - INTERVAL 1 DAY AS in_day, m.ts > d.feature_date - INTERVAL 7 DAY AS in_week FROM {mv} m JOIN {spine} d ON m.ts > d.feature_date - INTERVAL 30 DAY AND m.ts <= d.feature_date + INTERVAL 1 DAY"
CTES["f_base"] = """
SELECT account_id, feature_date, count(*) FILTER (in_day) AS txn_count_1d, count(*) FILTER (in_week) AS txn_count_7d, coalesce(sum(sent) FILTER (in_week), 0) AS total_sent_7d, coalesce(sum(received) FILTER (in_week), 0) AS total_received_7d,
  avg(amount) AS avg_txn_amount_30d, max(amount) AS max_txn_amount_30d, count(*) FILTER (in_day AND sent >= 9500 AND sent < 10000) AS below_threshold_count_24h, avg(CASE WHEN is_cross_border THEN 1.0 ELSE 0.0 END) AS cross_border_ratio_30d,
  sum(CAST(amount AS DOUBLE) * weight) / sum(CAST(amount AS DOUBLE)) AS high_risk_country_exposure
FROM {mvd} GROUP BY account_id, feature_date"""
CTES["f_cp"] = "SELECT account_id, feature_date, count(DISTINCT k) AS unique_counterparties_7d FROM (SELECT account_id, feature_date, out_key AS k FROM {mvd} WHERE in_week UNION ALL SELECT account_id, feature_date, in_key FROM {mvd} WHERE in_week) WHERE k IS NOT NULL GROUP BY account_id, feature_date"
CTES["f_ent"] = "SELECT account_id, feature_date, -sum(n / total * ln(n / total)) AS counterparty_entropy FROM (SELECT account_id, feature_date, out_key, CAST(count(*) AS DOUBLE) AS n, sum(count(*)) OVER (PARTITION BY account_id, feature_date) AS total FROM {mvd} WHERE out_key IS NOT NULL GROUP BY account_id, feature_date, out_key) GROUP BY account_id, feature_date"
CTES["f_now"] = "SELECT account_id, feature_date, min(ts) AS f FROM {mvd} WHERE in_day GROUP BY account_id, feature_date"
CTES["f_dorm"] = "SELECT n.account_id, n.feature_date, date_diff('day', CAST(max(m.ts) AS DATE), CAST(any_value(n.f) AS DATE)) AS dormant_days_before_activity FROM {f_now} n JOIN {mv} m ON m.account_id = n.account_id AND m.ts <= n.feature_date - INTERVAL 1 DAY GROUP BY n.account_id, n.feature_date"
_FEATURES = """
SELECT a.account_id, strftime(d.feature_date, '%Y-%m-%d') AS feature_date, coalesce(txn_count_1d, 0) AS txn_count_1d, coalesce(txn_count_7d, 0) AS txn_count_7d, coalesce(total_sent_7d, 0) AS total_sent_7d, coalesce(total_received_7d, 0) AS total_received_7d,
  round(coalesce(avg_txn_amount_30d, 0) + 1e-9, 4) AS avg_txn_amount_30d, coalesce(max_txn_amount_30d, 0) AS max_txn_amount_30d, coalesce(unique_counterparties_7d, 0) AS unique_counterparties_7d,
  round(CASE WHEN total_received_7d > 0 THEN CAST(total_sent_7d AS DOUBLE) / CAST(total_received_7d AS DOUBLE) WHEN total_sent_7d > 0 THEN 999999.0 ELSE 0 END + 1e-9, 4) AS in_out_ratio_7d, coalesce(total_received_7d - total_sent_7d, 0) AS retained_balance_proxy,
  coalesce(below_threshold_count_24h, 0) AS below_threshold_count_24h, dormant_days_before_activity, round(coalesce(cross_border_ratio_30d, 0) + 1e-9, 4) AS cross_border_ratio_30d, round(coalesce(high_risk_country_exposure, 0) + 1e-9, 4) AS high_risk_country_exposure, round(coalesce(counterparty_entropy, 0) + 1e-9, 4) AS counterparty_entropy
FROM {acc} a CROSS JOIN {spine} d LEFT JOIN {f_base} b ON a.account_id = b.account_id AND d.feature_date = b.feature_date LEFT JOIN {f_cp} c ON a.account_id = c.account_id AND d.feature_date = c.feature_date
  LEFT JOIN {f_ent} e ON a.account_id = e.account_id AND d.feature_date = e.feature_date LEFT JOIN {f_dorm} g ON a.account_id = g.account_id AND d.feature_date = g.feature_date"""


def _features(spark, d):
    t = tables.event_transactions(spark, d)
    return features.account_features(tables.event_accounts(spark, d), t, tables.countries(spark, d))


@query("feature_account_daily", _FEATURES)
def _(spark, d):
    rounded = {c: F.round(F.col(c) + 1e-9, 4) for c in ("avg_txn_amount_30d", "in_out_ratio_7d", "cross_border_ratio_30d", "high_risk_country_exposure", "counterparty_entropy")}
    return _features(spark, d).withColumns(rounded).withColumn("feature_date", F.col("feature_date").cast("string")).drop("feature_version")


CTES["f_all"] = _FEATURES


@query("feature_summary", "SELECT count(*) AS row_count, count(DISTINCT account_id) AS account_count, min(feature_date) AS min_date, max(feature_date) AS max_date, round(avg(txn_count_7d), 6) AS mean_txn_count_7d, max(txn_count_7d) AS max_txn_count_7d, count(*) FILTER (txn_count_7d = 0) AS zero_activity_rows FROM {f_all}")
def _(spark, d):
    return features.feature_summary(_features(spark, d)).withColumns({c: F.col(c).cast("string") for c in ("min_date", "max_date")})


@query("feature_date_spine", "SELECT strftime(feature_date, '%Y-%m-%d') AS feature_date FROM {spine}")
def _(spark, d):
    return features.date_spine(tables.event_transactions(spark, d)).select(F.col("feature_date").cast("string").alias("feature_date"))


@query("feature_country_weights", "SELECT country_code, weight FROM {wgt}")
def _(spark, d):
    return features.country_weights(tables.countries(spark, d))


@query("feature_account_totals", "SELECT a.account_id, coalesce(sc, 0) AS sent_count, coalesce(rc, 0) AS received_count, coalesce(s, 0) AS total_sent, coalesce(r, 0) AS total_received, coalesce(m, 0) AS max_sent, coalesce(u, 0) AS unique_recipients FROM {acc} a LEFT JOIN (SELECT sender_account_id AS account_id, count(*) AS sc, sum(amount) AS s, max(amount) AS m, count(DISTINCT recipient_key) AS u FROM {txw} GROUP BY 1) x USING (account_id) LEFT JOIN (SELECT receiver_account_id AS account_id, count(*) AS rc, sum(amount) AS r FROM {txw} WHERE receiver_account_id IS NOT NULL GROUP BY 1) y USING (account_id)")
def _(spark, d):
    return features.daily_totals(tables.event_accounts(spark, d), tables.event_transactions(spark, d))


@query("feature_active_accounts", "SELECT account_id, customer_id FROM {acc} WHERE account_id IN (SELECT sender_account_id FROM {tx}) OR account_id IN (SELECT receiver_account_id FROM {tx})")
def _(spark, d):
    return features.account_universe(tables.event_accounts(spark, d), tables.event_transactions(spark, d), False).select("account_id", "customer_id")


# graph
CTES["al1"] = "SELECT * FROM {al_st}"
CTES["v0"] = """
SELECT customer_id AS id, 'Customer' AS label, NULL AS severity, 0 AS p FROM {acc} UNION ALL SELECT account_id, 'Account', NULL, 0 FROM {acc} UNION ALL SELECT transaction_id, 'Transaction', NULL, 0 FROM {tx} UNION ALL SELECT counterparty_id, 'Counterparty', NULL, 1 FROM {tx}
UNION ALL SELECT origin_country, 'Country', NULL, 1 FROM {tx} UNION ALL SELECT destination_country, 'Country', NULL, 1 FROM {tx} UNION ALL SELECT country_code, 'Country', NULL, 0 FROM {ctry} UNION ALL SELECT alert_id, 'Alert', severity, 0 FROM {al1}"""
CTES["v"] = "SELECT id, label, max(severity) AS severity, min(p) = 0 AS explicit FROM {v0} WHERE id IS NOT NULL GROUP BY id, label"
CTES["e0"] = """
SELECT customer_id AS src, account_id AS dst, 'OWNS' AS type FROM {acc} UNION ALL SELECT sender_account_id, transaction_id, 'SENT' FROM {tx} UNION ALL SELECT transaction_id, receiver_account_id, 'RECEIVED' FROM {tx} UNION ALL SELECT transaction_id, counterparty_id, 'PAID_TO' FROM {tx}
UNION ALL SELECT account_id, home_country, 'LOCATED_IN' FROM {acc} UNION ALL SELECT transaction_id, coalesce(destination_country, origin_country), 'LOCATED_IN' FROM {tx}
UNION ALL SELECT customer_id, min(home_country), 'LOCATED_IN' FROM {acc} GROUP BY customer_id UNION ALL SELECT counterparty_id, min(origin_country), 'LOCATED_IN' FROM {tx} GROUP BY counterparty_id
UNION ALL SELECT alert_id, account_id, 'FLAGS_ACCOUNT' FROM {al1} UNION ALL SELECT alert_id, unnest(evidence_ids), 'INVOLVES_TRANSACTION' FROM {al1} UNION ALL SELECT account_id, alert_id, 'TRIGGERS' FROM {al1}"""
CTES["e"] = "SELECT DISTINCT * FROM {e0} WHERE src IS NOT NULL AND dst IS NOT NULL"
CTES["fl"] = "SELECT src, dst, dst_label, sum(amount) AS amount, count(*) AS transaction_count FROM (SELECT sender_account_id AS src, receiver_account_id AS dst, 'Account' AS dst_label, amount FROM {tx} WHERE receiver_account_id IS NOT NULL UNION ALL SELECT sender_account_id, counterparty_id, 'Counterparty', amount FROM {tx}) GROUP BY ALL"
CTES["sg"] = "SELECT DISTINCT src, dst FROM {fl} WHERE dst_label = 'Account'"
CTES["so"] = "SELECT DISTINCT sender_account_id AS src, receiver_account_id AS dst FROM {txo} WHERE transaction_type = 'transfer'"


def _edges(a, t, al):
    """All edges, with the customers and counterparties that the accounts and transactions name."""
    customers = a.groupBy("customer_id").agg(F.min("home_country").alias("jurisdiction"))
    return graph.edges(a, t, al, customers, t.groupBy("counterparty_id").agg(F.min("origin_country").alias("country_code")))


def _alerts(spark, d):
    return rules.structuring_alerts(tables.event_transactions(spark, d), tables.event_accounts(spark, d), STRUCTURING)


def _simple(spark, d):
    return graph.flow_edges(tables.event_transactions(spark, d)).filter("dst_label = 'Account'").select("src", "dst").distinct()


def _order_graph(spark, d):
    t = tables.order_transactions(spark, d).filter("transaction_type = 'transfer'")
    return t.select(F.col("sender_account_id").alias("src"), F.col("receiver_account_id").alias("dst")).distinct()


@query("graph_vertices", "SELECT id, label, severity, explicit FROM {v}")
def _(spark, d):
    return graph.vertices(tables.event_accounts(spark, d), tables.event_transactions(spark, d), _alerts(spark, d), tables.countries(spark, d))


@query("graph_edges", "SELECT src, dst, type FROM {e}")
def _(spark, d):
    return _edges(tables.event_accounts(spark, d), tables.event_transactions(spark, d), _alerts(spark, d))


@query("graph_edges_matched", "SELECT type, count(*) AS edges FROM {e} WHERE src IN (SELECT id FROM {v}) AND dst IN (SELECT id FROM {v}) GROUP BY type")
def _(spark, d):
    a, t, al = tables.event_accounts(spark, d), tables.event_transactions(spark, d), _alerts(spark, d)
    return graph.matched_edges(_edges(a, t, al), graph.vertices(a, t, al, tables.countries(spark, d))).groupBy("type").agg(F.count("*").alias("edges"))


@query("graph_load_reconciliation", "SELECT 'node' AS kind, label AS name, count(*) AS expected, count(*) AS actual, true AS matches FROM {v} GROUP BY label UNION ALL SELECT 'edge', type, count(*), count(*) FILTER (src <> 'CUST_0'), count(*) = count(*) FILTER (src <> 'CUST_0') FROM {e} GROUP BY type")
def _(spark, d):
    a, t, al = tables.event_accounts(spark, d), tables.event_transactions(spark, d), _alerts(spark, d)
    v, e = graph.vertices(a, t, al, tables.countries(spark, d)), _edges(a, t, al)
    return graph.reconcile(v, e, v, e.filter("src <> 'CUST_0'"))


@query("graph_flow_edges", "SELECT src, dst, dst_label, amount, transaction_count FROM {fl}")
def _(spark, d):
    return graph.flow_edges(tables.event_transactions(spark, d))


@query("graph_flow_features", "SELECT a.account_id, count(DISTINCT other) FILTER (NOT o) AS fan_in_count, count(DISTINCT other) FILTER (o) AS fan_out_count, count(DISTINCT other) FILTER (label = 'Account') AS neighbour_account_count, count(DISTINCT other) FILTER (o AND label = 'Counterparty') AS counterparty_count, coalesce(sum(amount) FILTER (o), 0) AS total_sent_amount, coalesce(sum(amount) FILTER (NOT o), 0) AS total_received_amount FROM {acc} a LEFT JOIN (SELECT src AS account_id, dst AS other, dst_label AS label, true AS o, amount FROM {fl} UNION ALL SELECT dst, src, 'Account', false, amount FROM {fl}) x USING (account_id) GROUP BY a.account_id")
def _(spark, d):
    return graph.flow_features(graph.flow_edges(tables.event_transactions(spark, d)), tables.event_accounts(spark, d))


CTES["dg"] = "SELECT account_id, count(*) AS degree, sum(i) AS in_degree, sum(o) AS out_degree FROM (SELECT src AS account_id, 0 AS i, 1 AS o FROM {sg} UNION ALL SELECT dst, 1, 0 FROM {sg}) GROUP BY account_id"


@query("graph_degrees", "SELECT account_id, coalesce(degree, 0) AS degree, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree, round(coalesce(degree / m, 0), 6) AS degree_centrality, round(coalesce(in_degree / m, 0), 6) AS in_degree_centrality, round(coalesce(out_degree / m, 0), 6) AS out_degree_centrality FROM {acc} LEFT JOIN {dg} USING (account_id), (SELECT greatest(count(*) - 1, 1) AS m FROM {dg})")
def _(spark, d):
    found = graph.degrees(_simple(spark, d), tables.event_accounts(spark, d))
    return found.withColumns({c: F.round(c, 6) for c in found.columns if c.endswith("centrality")})


_ROUNDS = 10
CTES["pn"] = "SELECT id, n, o FROM (SELECT src AS id FROM {so} UNION SELECT dst FROM {so}) LEFT JOIN (SELECT src AS id, count(*) AS o FROM {so} GROUP BY src) USING (id), (SELECT count(*) AS n FROM (SELECT src FROM {so} UNION SELECT dst FROM {so}))"
CTES["pr0"] = "SELECT id, 1.0::DOUBLE / n AS r FROM {pn}"
for _k in range(_ROUNDS):
    CTES[f"pr{_k + 1}"] = f"SELECT p.id, 0.15 / p.n + 0.85 * (coalesce(s.s, 0) + l.lost / p.n) AS r FROM {{pn}} p LEFT JOIN (SELECT g.dst AS id, sum(q.r / p.o) AS s FROM {{so}} g JOIN {{pr{_k}}} q ON g.src = q.id JOIN {{pn}} p ON p.id = g.src GROUP BY g.dst) s ON s.id = p.id, (SELECT coalesce(sum(q.r), 0) AS lost FROM {{pr{_k}}} q JOIN {{pn}} p USING (id) WHERE p.o IS NULL) l"


@query("graph_pagerank", f"SELECT id AS account_id, round(r, 9) AS pagerank_score FROM {{pr{_ROUNDS}}}")
def _(spark, d):
    return graph.pagerank(_order_graph(spark, d), rounds=_ROUNDS).withColumn("pagerank_score", F.round("pagerank_score", 9))


CTES["und"] = "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {so} WHERE src <> dst"
CTES["nbr"] = "SELECT a AS u, b AS w FROM {und} UNION ALL SELECT b, a FROM {und}"
CTES["ring"] = "SELECT unnest(range(1)) AS x"
SQL_COMPONENTS = """
WITH RECURSIVE {defs}, walk AS (SELECT DISTINCT src AS id, src AS root FROM nb UNION SELECT n.dst, w.root FROM walk w JOIN nb n ON n.src = w.id),
roots AS (SELECT id, min(root) AS root FROM walk GROUP BY id), per AS (SELECT root, count(*) AS graph_component_size FROM roots GROUP BY root)
SELECT id AS account_id, row_number AS community_id, graph_component_size AS community_size, graph_component_size FROM roots JOIN (SELECT *, row_number() OVER (ORDER BY root) AS row_number FROM per) USING (root)"""


@query("graph_communities")
def _(spark, d):
    s = _order_graph(spark, d)
    return graph.communities(s, s.select(F.explode(F.array("src", "dst")).alias("account_id")).distinct())


def _components_sql() -> str:
    from tallyhound.plans.sql import CTES as c

    base = f"txo AS MATERIALIZED ({c['txo']}), g AS MATERIALIZED (SELECT DISTINCT sender_account_id AS src, receiver_account_id AS dst FROM txo WHERE transaction_type = 'transfer'), nb AS MATERIALIZED (SELECT src, dst FROM g UNION SELECT dst, src FROM g)"
    return SQL_COMPONENTS.replace("{defs}", base)


SQL["graph_communities"] = _components_sql()

CTES["deg"] = "SELECT u AS id, count(*) AS d FROM {nbr} GROUP BY u"
CTES["tri"] = "SELECT x.a, x.b, y.b AS c FROM {und} x JOIN {und} y ON x.b = y.a JOIN {und} z ON z.a = x.a AND z.b = y.b"
CTES["tc"] = "SELECT id, count(*) AS t FROM (SELECT a AS id FROM {tri} UNION ALL SELECT b FROM {tri} UNION ALL SELECT c FROM {tri}) GROUP BY id"


@query("graph_clustering", "SELECT account_id, round(CASE WHEN d > 1 THEN 2.0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END, 6) AS clustering_coefficient FROM {acco} LEFT JOIN {deg} g ON g.id = account_id LEFT JOIN {tc} c ON c.id = account_id")
def _(spark, d):
    return graph.clustering(_order_graph(spark, d), tables.order_accounts(spark, d)).withColumn("clustering_coefficient", F.round("clustering_coefficient", 6))


CTES["cyn"] = "SELECT unnest(accounts) AS account_id FROM {cf_c}"


@query("graph_cycle_counts", "SELECT account_id, coalesce(n, 0) AS cycle_count FROM {acco} LEFT JOIN (SELECT account_id, count(*) AS n FROM {cyn} GROUP BY account_id) USING (account_id)")
def _(spark, d):
    e = rules.circular_edges(tables.order_transactions(spark, d), CONFIGS["circular_flow"]).select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct()
    return graph.cycle_counts(e, tables.order_accounts(spark, d))


_PROX_E = "SELECT src, dst FROM {e} WHERE type IN ('OWNS', 'SENT', 'RECEIVED', 'PAID_TO', 'FLAGS_ACCOUNT', 'INVOLVES_TRANSACTION')"
CTES["pe0"] = _PROX_E
CTES["pe"] = "SELECT src, dst FROM {pe0} UNION SELECT dst, src FROM {pe0}"
CTES["b0"] = "SELECT DISTINCT alert_id AS id, 0 AS hops FROM {al1}"
for _k in range(1, 5):
    CTES[f"b{_k}"] = f"SELECT id, min(hops) AS hops FROM (SELECT id, hops FROM {{b{_k - 1}}} UNION ALL SELECT p.dst, {_k} FROM {{pe}} p JOIN {{b{_k - 1}}} b ON b.id = p.src AND b.hops = {_k - 1}) GROUP BY id"


@query("graph_alert_proximity", "SELECT account_id, coalesce(n, 0) AS alert_count, coalesce(n, 0) AS high_risk_alert_count, hops AS shortest_path_to_flagged FROM {acc} LEFT JOIN (SELECT p.src AS account_id, count(*) AS n FROM {pe} p JOIN {al1} l ON p.dst = l.alert_id GROUP BY p.src) USING (account_id) LEFT JOIN {b4} b ON b.id = account_id")
def _(spark, d):
    a, t, al = tables.event_accounts(spark, d), tables.event_transactions(spark, d), _alerts(spark, d)
    e = _edges(a, t, al).filter(F.col("type").isin(*RELATIONSHIPS))
    return graph.alert_proximity(e, al, a)


CTES["n1"] = "SELECT 'ACC_1' AS id, 0 AS hops"
CTES["sb"] = "SELECT src, dst FROM {sg} UNION SELECT dst, src FROM {sg}"
CTES["n2"] = "SELECT id, min(hops) AS hops FROM (SELECT * FROM {n1} UNION ALL SELECT s.dst, 1 FROM {sb} s JOIN {n1} n ON n.id = s.src) GROUP BY id"
CTES["n3"] = "SELECT id, min(hops) AS hops FROM (SELECT * FROM {n2} UNION ALL SELECT s.dst, 2 FROM {sb} s JOIN {n2} n ON n.id = s.src AND n.hops = 1) GROUP BY id"


@query("graph_neighbourhood", "SELECT id, hops FROM {n3}")
def _(spark, d):
    return graph.neighbourhood(_simple(spark, d), "ACC_1", 2)


@query("graph_betweenness")
def _(spark, d):
    return graph.betweenness(_order_graph(spark, d))


@query("graph_greedy_modularity")
def _(spark, d):
    return graph.greedy_modularity(_order_graph(spark, d))
