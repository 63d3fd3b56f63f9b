"""Queries of account scores, cases, case scores and evidence."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tallyhound.functions.analytic import nearest, percentile_ranks
from tallyhound.checkpoints import checkpointed
from tallyhound.operators import cases, graph, rules, scoring
from tallyhound.plans import graph_queries  # noqa: F401  its expressions are used here
from tallyhound.plans.rule_queries import CONFIGS, event_alerts, joined
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


# inputs that the models would give, by arithmetic
CTES["an"] = "SELECT account_id, CAST((CAST(substr(account_id, 5) AS BIGINT) * 37 + v * 11) % 101 AS DOUBLE) AS anomaly_score FROM {acc}, (SELECT unnest([0, 1]) AS v)"
CTES["gfi"] = "SELECT account_id, count(DISTINCT s.src) AS fi FROM {acc} LEFT JOIN {sg} s ON s.dst = account_id GROUP BY account_id"
CTES["gfa"] = "SELECT account_id, count(*) AS n FROM {al} GROUP BY account_id"
CTES["gf"] = "SELECT f.account_id, fi / 1000.0::DOUBLE AS pagerank_score, fi / 500.0::DOUBLE AS degree_centrality, (fi % 5) / 10.0::DOUBLE AS betweenness_centrality, fi % 7 AS cycle_count, fi % 3 AS community_id, fi % 4 AS community_size, coalesce(n, 0) AS high_risk_alert_count, CASE WHEN n > 0 THEN 1 WHEN fi % 2 = 0 THEN 3 END AS shortest_path_to_flagged FROM {gfi} f LEFT JOIN {gfa} a ON f.account_id = a.account_id"


def anomalies(spark, d):
    a = tables.event_accounts(spark, d).withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    return a.select("account_id", ((F.substring("account_id", 5, 20).cast("long") * 37 + F.col("v") * 11) % 101).cast("double").alias("anomaly_score"))


def graph_inputs(spark, d, alerts):
    simple = graph.flow_edges(tables.event_transactions(spark, d)).filter("dst_label = 'Account'").select("src", "dst").distinct()
    fan = simple.groupBy(F.col("dst").alias("account_id")).agg(F.count("*").alias("fi"))
    n = alerts.groupBy("account_id").agg(F.count("*").alias("n"))
    f = F.col("fi")
    full = tables.event_accounts(spark, d).select("account_id").join(fan, "account_id", "left").join(n, "account_id", "left").withColumn("fi", F.coalesce("fi", F.lit(0).cast("long")))
    return full.select("account_id", (f / 1000).alias("pagerank_score"), (f / 500).alias("degree_centrality"), ((f % 5) / 10).alias("betweenness_centrality"), (f % 7).alias("cycle_count"), (f % 3).alias("community_id"), (f % 4).alias("community_size"), F.coalesce("n", F.lit(0).cast("long")).alias("high_risk_alert_count"), F.when(F.col("n") > 0, 1).when(f % 2 == 0, 3).alias("shortest_path_to_flagged"))


def _pct(value: str, source: str, single: bool = False) -> str:
    rank = f"(rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2.0) / count(*) OVER () * 100"
    return f"CASE WHEN count(*) OVER () = 1 THEN CASE WHEN {value} > 0 THEN 100.0 ELSE 0.0 END ELSE {rank} END" if single else f"({rank})"


_SEV = "CASE lower(severity) WHEN 'low' THEN 25.0 WHEN 'medium' THEN 50.0 WHEN 'high' THEN 75.0 WHEN 'critical' THEN 100.0 ELSE 0.0 END"
CTES["s_rule"] = f"SELECT a.account_id, coalesce(least(100, m + (n - 1) * 2.0), 0)::DOUBLE AS rule_risk_score, coalesce(n, 0) AS alert_count, coalesce(h, 0) AS high_severity_alert_count, coalesce(m, 0)::DOUBLE AS max_rule_alert_score, coalesce(av, 0)::DOUBLE AS mean_rule_alert_score FROM {{acc}} a LEFT JOIN (SELECT account_id, count(*) AS n, count(*) FILTER (severity = 'high') AS h, max(greatest(risk_score_rule, {_SEV})) AS m, avg(greatest(risk_score_rule, {_SEV})) AS av FROM {{al}} GROUP BY account_id) g ON a.account_id = g.account_id"
CTES["s_gp"] = f"SELECT account_id, {_pct('pagerank_score', 'gf', True)} AS p, {_pct('degree_centrality', 'gf', True)} AS d, {_pct('betweenness_centrality', 'gf', True)} AS b, {_pct('cycle_count', 'gf', True)} AS c, {_pct('high_risk_alert_count', 'gf', True)} AS h, coalesce(greatest(0, least(100, 125 - 25 * shortest_path_to_flagged)), 0) AS x FROM {{gf}}"
CTES["s_graph"] = "SELECT account_id, least(100, p * 0.25 + d * 0.15 + b * 0.15 + c * 0.15 + h * 0.2 + x * 0.1)::DOUBLE AS graph_risk_score, ((p + d + b + c + h) / 5)::DOUBLE AS graph_percentile_score FROM {s_gp}"
CTES["s_an"] = "SELECT account_id, max(anomaly_score) AS anomaly_risk_score FROM {an} GROUP BY account_id"
CTES["s_cust"] = "SELECT account_id, CASE customer_risk_rating WHEN 'low' THEN 20.0 WHEN 'medium' THEN 50.0 WHEN 'high' THEN 80.0 ELSE 50.0 END::DOUBLE AS customer_risk_score FROM {acc}"
CTES["s_jur"] = "SELECT a.account_id, coalesce(w * 100 + (1 - w) * 30, 50)::DOUBLE AS jurisdiction_risk_score FROM {acc} a LEFT JOIN (SELECT country_code, weight AS w FROM {wgt}) c ON a.home_country = c.country_code AND CAST(substr(account_id, 5) AS BIGINT) % 3 <> 0"
CTES["comp"] = "SELECT * FROM {s_rule} JOIN {s_graph} USING (account_id) JOIN {s_an} USING (account_id) JOIN {s_cust} USING (account_id) JOIN {s_jur} USING (account_id)"


def band_sql(x: str) -> str:
    return f"CASE WHEN {x} >= 90 THEN 'critical' WHEN {x} >= 75 THEN 'high' WHEN {x} >= 50 THEN 'medium' ELSE 'low' END"


CTES["score0"] = "SELECT *, round(least(100, greatest(0, rule_risk_score * 0.35 + graph_risk_score * 0.25 + anomaly_risk_score * 0.25 + customer_risk_score * 0.1 + jurisdiction_risk_score * 0.05)), 6) AS account_risk_score FROM {comp}"
CTES["score"] = f"SELECT *, {band_sql('account_risk_score')} AS risk_band, row_number() OVER (ORDER BY account_risk_score DESC, account_id) AS risk_rank FROM {{score0}}"


def exposure(spark, d):
    from tallyhound.operators.features import country_weights

    w = F.broadcast(country_weights(tables.countries(spark, d)))  # one row a country
    known = F.when(F.substring("account_id", 5, 20).cast("long") % 3 != 0, F.col("weight"))  # a third has no exposure
    a = tables.event_accounts(spark, d)
    return a.join(w, a["home_country"] == w["country_code"], "left").select("account_id", known.alias("high_risk_country_exposure"))


def account_scores(spark, d, alerts=None):
    alerts = event_alerts(spark, d) if alerts is None else alerts
    return scoring.account_scores(scoring.account_components(tables.event_accounts(spark, d), alerts, graph_inputs(spark, d, alerts), anomalies(spark, d), exposure(spark, d)))


def rounded(frame, places=6):
    return frame.withColumns({c: nearest(c, places) for c, t in frame.dtypes if t == "double"})


@query("score_rule_component", "SELECT * FROM {s_rule}")
def _(spark, d):
    return scoring.rule_component(tables.event_accounts(spark, d), event_alerts(spark, d)).drop("critical_severity_alert_count")


@query("score_graph_component", "SELECT account_id, round(graph_risk_score, 6) AS graph_risk_score, round(graph_percentile_score, 6) AS graph_percentile_score FROM {s_graph}")
def _(spark, d):
    return rounded(scoring.graph_component(tables.event_accounts(spark, d), graph_inputs(spark, d, event_alerts(spark, d))))


@query("score_anomaly_component", "SELECT * FROM {s_an}")
def _(spark, d):
    return scoring.anomaly_component(tables.event_accounts(spark, d), anomalies(spark, d))


@query("score_customer_component", "SELECT * FROM {s_cust}")
def _(spark, d):
    return scoring.customer_component(tables.event_accounts(spark, d))


@query("score_jurisdiction_component", "SELECT account_id, round(jurisdiction_risk_score, 6) AS jurisdiction_risk_score FROM {s_jur}")
def _(spark, d):
    return rounded(scoring.jurisdiction_component(tables.event_accounts(spark, d), exposure(spark, d)))


@query("score_account_risk", "SELECT account_id, account_risk_score, risk_band, risk_rank FROM {score}")
def _(spark, d):
    return account_scores(spark, d).select("account_id", "account_risk_score", "risk_band", "risk_rank")


@query("score_percentile_ranks", f"SELECT account_id, cycle_count, round({_pct('cycle_count', 'gf')}, 6) AS percentile FROM {{gf}}")
def _(spark, d):
    g = graph_inputs(spark, d, event_alerts(spark, d)).select("account_id", "cycle_count")
    return rounded(percentile_ranks(g, {"cycle_count": "percentile"}))


@query("score_distribution", "SELECT count(*) AS n, min(account_risk_score) AS least, max(account_risk_score) AS most, round(avg(account_risk_score), 6) AS mean, round(median(account_risk_score), 6) AS median, round(stddev_pop(account_risk_score), 6) AS deviation, count(*) FILTER (risk_band = 'high') AS high, count(*) FILTER (risk_band = 'medium') AS medium FROM {score}")
def _(spark, d):
    from tallyhound.operators.read_api import score_distribution

    return rounded(score_distribution(account_scores(spark, d), "account_risk_score")).select("n", "least", "most", "mean", "median", "deviation", "high", "medium")


# cases
_TOP = "row_number() OVER (PARTITION BY k ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, risk_score_rule DESC, alert_id)"


def grouped(name: str, strategy: str, keyed: str, accounts: str = "list_sort(list(DISTINCT account_id))") -> None:
    CTES[f"{name}_k"] = keyed
    CTES[name] = f"""
SELECT k AS case_group_key, '{strategy}' AS grouping_strategy, list_sort(list(DISTINCT alert_id)) AS alert_ids, {accounts} AS account_ids, coalesce(list_sort(list(DISTINCT customer_id) FILTER (customer_id IS NOT NULL)), []) AS customer_ids,
  list_sort(list_distinct(flatten(list(evidence_ids)))) AS transaction_ids, list_sort(list(DISTINCT typology)) AS typologies, list_sort(list(DISTINCT rule_name)) AS rule_names
FROM (SELECT *, {_TOP} AS r FROM {{{name}_k}}) WHERE r <= 50 GROUP BY k"""


grouped("g_acc", "account", "SELECT *, account_id AS k FROM {al}")
CTES["cust_acc"] = "SELECT customer_id AS k, list_sort(list(DISTINCT account_id)) AS every FROM {acc} GROUP BY customer_id"
grouped("g_cust", "customer", "SELECT l.*, c.k, c.every FROM {al} l JOIN {cust_acc} c ON l.customer_id = c.k", "any_value(every)")
grouped("g_com", "graph_community", "SELECT l.*, 'community:' || g.community_id AS k FROM {al} l JOIN {gf} g ON l.account_id = g.account_id")
CTES["cp"] = "SELECT DISTINCT x.alert_id, t.counterparty_id AS k FROM (SELECT alert_id, unnest(evidence_ids) AS transaction_id FROM {al}) x JOIN {tx} t ON x.transaction_id = t.transaction_id"
grouped("g_cp", "common_counterparty", "SELECT l.*, p.k FROM {al} l JOIN {cp} p ON l.alert_id = p.alert_id")
CTES["g_all"] = "SELECT *, 'CASE_GROUP_' || upper(grouping_strategy) || '_' || substr(sha256(concat_ws('|', grouping_strategy, case_group_key, array_to_string(alert_ids, '|'))), 1, 16) AS case_group_id FROM (" + " UNION ALL ".join(f"SELECT * FROM {{{g}}}" for g in ("g_acc", "g_cust", "g_com", "g_cp")) + ")"
CTES["g_one"] = "SELECT *, account_ids[1] AS primary_account_id, customer_ids[1] AS primary_customer_id FROM (SELECT *, row_number() OVER (PARTITION BY grouping_strategy, array_to_string(alert_ids, '|') ORDER BY case_group_id) AS r1 FROM {g_all}) WHERE r1 = 1"
CTES["grp"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY primary_account_id ORDER BY grouping_strategy, case_group_id) AS r2 FROM {g_one}) WHERE r2 <= 5 ORDER BY primary_account_id NULLS LAST, grouping_strategy, case_group_id LIMIT 1000"
CTES["cs_al"] = "SELECT g.case_group_id, max(l.risk_score_rule) AS mx, avg(l.risk_score_rule) AS mn FROM (SELECT case_group_id, unnest(alert_ids) AS alert_id FROM {grp}) g JOIN {al} l ON g.alert_id = l.alert_id GROUP BY g.case_group_id"
CTES["cs_ac"] = "SELECT g.case_group_id, max(s.account_risk_score) AS ar FROM (SELECT case_group_id, unnest(account_ids) AS account_id FROM {grp}) g JOIN {score} s ON g.account_id = s.account_id GROUP BY g.case_group_id"
CTES["cs_tx"] = "SELECT g.case_group_id, sum(t.amount) AS v FROM (SELECT case_group_id, unnest(transaction_ids) AS transaction_id FROM {grp}) g JOIN {tx} t ON g.transaction_id = t.transaction_id GROUP BY g.case_group_id"
CTES["cs0"] = "SELECT g.*, mx::DOUBLE AS max_rule_risk_score, mn::DOUBLE AS mean_rule_risk_score, coalesce(ar, 0)::DOUBLE AS max_account_risk_score, coalesce(v, 0) AS total_transaction_value, round(least(100, greatest(coalesce(ar, 0), mx) + least(10, (len(alert_ids) - 1) * 1.5))::DOUBLE, 6) AS priority_score, 'CASE_CASE_GENERATION_V1_' || substr(sha256('case_generation_v1|' || g.case_group_id), 1, 16) AS case_id, 'high' AS severity, len(alert_ids) AS alert_count, len(transaction_ids) AS evidence_transaction_count FROM {grp} g JOIN {cs_al} USING (case_group_id) LEFT JOIN {cs_ac} USING (case_group_id) LEFT JOIN {cs_tx} USING (case_group_id)"
CTES["cs"] = "SELECT *, len(alert_ids) || ' alerts for ' || primary_account_id || ' grouped by ' || grouping_strategy || '; ' || len(typologies) || ' typologies; ' || severity || ' severity; priority ' || printf('%.2f', priority_score) || '.' AS summary FROM {cs0}"


#: Every group with every alert of it, none dropped after a number.
CTES["w_k"] = " UNION ALL ".join(f"SELECT '{strategy}' AS grouping_strategy, k, alert_id FROM {{{g}_k}}" for g, strategy in (("g_acc", "account"), ("g_cust", "customer"), ("g_com", "graph_community"), ("g_cp", "common_counterparty")))
CTES["w_all"] = "SELECT grouping_strategy, alert_ids, 'CASE_GROUP_' || upper(grouping_strategy) || '_' || substr(sha256(concat_ws('|', grouping_strategy, k, array_to_string(alert_ids, '|'))), 1, 16) AS case_group_id FROM (SELECT grouping_strategy, k, list_sort(list(DISTINCT alert_id)) AS alert_ids FROM {w_k} GROUP BY grouping_strategy, k)"
CTES["w_cs"] = "SELECT 'CASE_CASE_GENERATION_V1_' || substr(sha256('case_generation_v1|' || min(case_group_id)), 1, 16) AS case_id, alert_ids FROM {w_all} GROUP BY grouping_strategy, alert_ids"

GROUPING = cases.CaseConfig(strategies=("account", "customer", "graph_community", "common_counterparty"))
WHOLE = replace(GROUPING, max_alerts=None, max_per_account=None, max_cases=None)


def groups(spark, d, alerts, c=GROUPING):
    return cases.case_groups(alerts, tables.event_accounts(spark, d), graph_inputs(spark, d, alerts), tables.event_transactions(spark, d), c)


def made_cases(spark, d, alerts=None):
    """Alerts are used in many places, so they are kept once computed."""
    alerts = checkpointed(event_alerts(spark, d)) if alerts is None else alerts
    scores = account_scores(spark, d, alerts)
    return cases.cases_from_groups(checkpointed(groups(spark, d, alerts)), alerts, scores, tables.event_transactions(spark, d)), alerts, scores


@query("case_groups", "SELECT case_group_id, grouping_strategy, primary_account_id, primary_customer_id, case_group_key, array_to_string(alert_ids, '|') AS alert_ids, array_to_string(account_ids, '|') AS account_ids, array_to_string(customer_ids, '|') AS customer_ids, array_to_string(transaction_ids, '|') AS transaction_ids, array_to_string(typologies, '|') AS typologies, array_to_string(rule_names, '|') AS rule_names FROM {grp}")
def _(spark, d):
    return joined(groups(spark, d, checkpointed(event_alerts(spark, d))))


@query("case_group_circular", "SELECT 'CASE_GROUP_CIRCULAR_FLOW_' || substr(sha256(concat_ws('|', 'circular_flow', 'evidence:' || array_to_string(list_sort(evidence_ids), '|'), array_to_string(list_sort(list(alert_id)), '|'))), 1, 16) AS case_group_id, array_to_string(list_sort(list(alert_id)), '|') AS alert_ids FROM {al_cf} GROUP BY list_sort(evidence_ids), evidence_ids")
def _(spark, d):
    al = rules.circular_alerts(tables.order_transactions(spark, d), tables.order_accounts(spark, d), CONFIGS["circular_flow"])
    return joined(cases.by_circular_flow(al).select("case_group_id", "alert_ids"))


@query("case_records", "SELECT case_id, primary_account_id, alert_count, evidence_transaction_count, total_transaction_value, max_rule_risk_score, round(mean_rule_risk_score, 6) AS mean_rule_risk_score, max_account_risk_score, priority_score, severity, summary FROM {cs}")
def _(spark, d):
    made, _, _ = made_cases(spark, d)
    return made.select("case_id", "primary_account_id", "alert_count", "evidence_transaction_count", "total_transaction_value", "max_rule_risk_score", F.round("mean_rule_risk_score", 6).alias("mean_rule_risk_score"), "max_account_risk_score", "priority_score", "severity", "summary")


@query("case_alert_links", "SELECT case_id, unnest(alert_ids) AS alert_id FROM {cs}")
def _(spark, d):
    return cases.case_alerts(made_cases(spark, d)[0])


@query("case_entity_links", "SELECT case_id, 'account' AS entity_type, e AS entity_id, CASE WHEN e = p THEN 'primary' ELSE 'related' END AS role FROM (SELECT case_id, unnest(account_ids) AS e, primary_account_id AS p FROM {cs}) UNION ALL SELECT case_id, 'customer', e, CASE WHEN e = p THEN 'primary' ELSE 'related' END FROM (SELECT case_id, unnest(customer_ids) AS e, primary_customer_id AS p FROM {cs}) UNION ALL SELECT case_id, 'transaction', unnest(transaction_ids), 'evidence' FROM {cs}")
def _(spark, d):
    return cases.case_entities(made_cases(spark, d)[0])


@query("case_summary", "SELECT count(*) AS case_count, sum(alert_count) AS linked_alerts, max(priority_score) AS max_priority, round(avg(priority_score), 6) AS mean_priority, count(*) FILTER (severity = 'critical') AS critical_cases, count(DISTINCT primary_account_id) AS account_count FROM {cs}")
def _(spark, d):
    return cases.case_summary(made_cases(spark, d)[0])


CTES["cg_p"] = f"SELECT account_id, {_pct('pagerank_score', 'gf')} AS p, {_pct('degree_centrality', 'gf')} AS d, {_pct('cycle_count', 'gf')} AS c, {_pct('community_size', 'gf')} AS m, {_pct('high_risk_alert_count', 'gf')} AS h, coalesce(100.0 / (1 + greatest(0, shortest_path_to_flagged - 1)), 0) AS x FROM {{gf}}"
CTES["cg"] = "SELECT account_id, least(100, p * 0.25 + d * 0.2 + c * 0.2 + m * 0.15 + (h + x) / 2 * 0.2) AS g FROM {cg_p}"
CTES["cc_ac"] = "SELECT case_id, max(s.account_risk_score) AS account_risk_score, max(g.g) AS graph_risk_score, max(a.anomaly_risk_score) AS ma, avg(a.anomaly_risk_score) AS av, count(*) AS related_account_count FROM (SELECT case_id, unnest(account_ids) AS account_id FROM {cs}) c LEFT JOIN {score} s USING (account_id) LEFT JOIN {cg} g USING (account_id) LEFT JOIN {s_an} a USING (account_id) GROUP BY case_id"
CTES["cc_v"] = f"SELECT case_id, {_pct('total_transaction_value', 'cs')} * 0.5 + {_pct('evidence_transaction_count', 'cs')} * 0.25 + {_pct('len(account_ids)', 'cs')} * 0.25 AS evidence_value_score FROM {{cs}}"
CTES["cc"] = "SELECT c.case_id, max_rule_risk_score * 0.7 + mean_rule_risk_score * 0.3 AS alert_risk_score, coalesce(account_risk_score, 0) AS account_risk_score, coalesce(graph_risk_score, 0) AS graph_risk_score, coalesce(ma * 0.75 + av * 0.25, 0) AS anomaly_risk_score, least(100, len(typologies) * 25.0) AS typology_diversity_score, evidence_value_score, related_account_count FROM {cs} c JOIN {cc_ac} USING (case_id) JOIN {cc_v} USING (case_id)"
CTES["csc"] = "SELECT *, round((alert_risk_score * 0.25 + account_risk_score * 0.25 + graph_risk_score * 0.15 + anomaly_risk_score * 0.15 + typology_diversity_score * 0.1 + evidence_value_score * 0.1)::DOUBLE, 6) AS case_risk_score FROM {cc}"


def scored_cases(spark, d):
    made, alerts, scores = made_cases(spark, d)
    made = checkpointed(made)
    g = graph_inputs(spark, d, alerts)
    return made, alerts, scores, g, cases.case_scores(cases.case_components(made, alerts, scores, g, anomalies(spark, d)))


@query("case_risk_components", "SELECT case_id, round(alert_risk_score, 4) AS alert_risk_score, round(account_risk_score, 4) AS account_risk_score, round(graph_risk_score, 4) AS graph_risk_score, round(anomaly_risk_score, 4) AS anomaly_risk_score, typology_diversity_score::DOUBLE AS typology_diversity_score, round(evidence_value_score, 4) AS evidence_value_score, related_account_count FROM {cc}")
def _(spark, d):
    return rounded(scored_cases(spark, d)[4], 4).select("case_id", "alert_risk_score", "account_risk_score", "graph_risk_score", "anomaly_risk_score", "typology_diversity_score", "evidence_value_score", "related_account_count")


@query("case_risk_scores", f"SELECT case_id, round(case_risk_score, 4) AS case_risk_score, {band_sql('case_risk_score')} AS risk_band FROM {{csc}}")
def _(spark, d):
    return scored_cases(spark, d)[4].select("case_id", nearest("case_risk_score", 4).alias("case_risk_score"), "risk_band")


@query("case_transaction_evidence", "SELECT case_id, count(*) AS transaction_count, sum(amount) AS total_value, max(amount) AS max_value, count(DISTINCT counterparty_id) AS counterparty_count, count(DISTINCT destination_country) AS country_count FROM (SELECT case_id, unnest(transaction_ids) AS transaction_id FROM {cs}) JOIN {tx} USING (transaction_id) GROUP BY case_id")
def _(spark, d):
    e = cases.transaction_evidence(made_cases(spark, d)[0], tables.event_transactions(spark, d))
    return e.select("case_id", *[f"transaction_evidence.{c}" for c in ("transaction_count", "total_value", "max_value", "counterparty_count", "country_count")])


@query("case_alert_evidence", "SELECT case_id, count(*) AS alert_count, array_to_string(list_sort(list(DISTINCT typology)), '|') AS typologies, array_to_string(list_sort(list(DISTINCT reason_code)), '|') AS reason_codes, count(*) FILTER (severity = 'high') AS high_count, max(risk_score_rule) AS max_rule_risk_score FROM (SELECT case_id, unnest(alert_ids) AS alert_id FROM {w_cs}) JOIN {al} USING (alert_id) GROUP BY case_id")
def _(spark, d):
    """All alerts of all groups; what a case has beside its alerts isn't made."""
    alerts = checkpointed(event_alerts(spark, d))
    made = checkpointed(cases.identified(groups(spark, d, alerts, WHOLE), WHOLE))
    e, t = cases.alert_evidence(made, alerts, cases.EvidenceConfig(max_alerts=None)), "typology_evidence"
    return e.select("case_id", "alert_evidence.alert_count", F.array_join(f"{t}.typologies", "|").alias("typologies"), F.array_join(f"{t}.reason_codes", "|").alias("reason_codes"), F.col(f"{t}.severity_counts.high").alias("high_count"), f"{t}.max_rule_risk_score")


@query("case_chronology", "SELECT case_id, detection_window_start AS at, 'alert' AS kind, alert_id AS id FROM (SELECT case_id, unnest(alert_ids) AS alert_id FROM {cs}) JOIN {al} USING (alert_id) UNION ALL SELECT case_id, strftime(transaction_timestamp, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(transaction_timestamp) % 1000000 <> 0 THEN strftime(transaction_timestamp, '.%f') ELSE '' END || '+00:00', 'transaction', transaction_id FROM (SELECT case_id, unnest(transaction_ids) AS transaction_id FROM {cs}) JOIN {tx} USING (transaction_id)")
def _(spark, d):
    made, alerts, _ = made_cases(spark, d)
    return cases.chronology(made, alerts, tables.event_transactions(spark, d))


@query("case_risk_drivers", "SELECT case_id, count(*) AS drivers FROM (SELECT case_id, unnest([alert_risk_score, account_risk_score, graph_risk_score, anomaly_risk_score, typology_diversity_score, evidence_value_score]) AS x FROM {cc}) WHERE round(x, 6) >= 75 GROUP BY case_id")
def _(spark, d):
    return cases.risk_drivers(scored_cases(spark, d)[4]).select("case_id", F.size("drivers").cast("long").alias("drivers")).filter("drivers > 0")


@query("case_evidence_packs")
def _(spark, d):
    made, alerts, scores, g, scored = scored_cases(spark, d)
    packs = cases.evidence_packs(made, alerts, tables.event_transactions(spark, d), scores, anomalies(spark, d), g, scored)
    return packs.select("case_id", "explanation_text", F.array_join("explanation_bullets", "|").alias("explanation_bullets"), F.array_join("recommended_review_focus", "|").alias("recommended_review_focus"), F.to_json("evidence_quality").alias("evidence_quality"))
