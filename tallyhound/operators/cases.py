"""Case groups, cases, case risk, evidence packs and explanations."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.functions import ids
from tallyhound.functions.analytic import band, global_rank, percentile_ranks
from tallyhound.functions.normalise import clip_score, unique
from tallyhound.operators.rules import last_customers
from tallyhound.operators.scoring import SEVERITY, SEVERITY_RANK, lookup

GROUP_COLUMNS = ("case_group_id", "grouping_strategy", "primary_account_id", "primary_customer_id", "alert_ids", "account_ids", "customer_ids", "transaction_ids", "typologies", "rule_names", "case_group_key")


@dataclass(frozen=True)
class CaseConfig:
    version: str = "case_generation_v1"
    strategies: tuple[str, ...] = ("account", "customer", "graph_community", "circular_flow", "common_counterparty")
    min_alerts: int = 1
    #: Of these three, None keeps all.
    max_alerts: int | None = 50
    max_per_account: int | None = 5
    max_cases: int | None = 1000
    default_status: str = "New"
    uplift_per_alert: float = 1.5
    max_uplift: float = 10.0

    def __post_init__(self) -> None:
        if not 1 <= self.min_alerts <= (self.max_alerts or self.min_alerts) or any(x is not None and x < 1 for x in (self.max_alerts, self.max_per_account, self.max_cases)):
            raise ValueError("limits are positive and in order")


def with_customer(alerts: DataFrame, accounts: DataFrame) -> DataFrame:
    """Alerts whose missing customer is the account's."""
    one = last_customers(accounts).withColumnRenamed("customer_id", "_customer")
    return alerts.join(one, "account_id", "left").withColumn("customer_id", F.coalesce("customer_id", "_customer")).drop("_customer")


def _grouped(keyed: DataFrame, strategy: str, c: CaseConfig, account_ids: DataFrame | None = None) -> DataFrame:
    """One row a key from alerts with ``_key``: the alerts are cut to the most severe before anything is gathered, if they are cut.
    ``account_ids``: _key and the accounts to name instead of the alerts' own."""
    top = keyed
    if c.max_alerts is not None:
        severity = lookup(F.col("severity"), SEVERITY_RANK, 0)
        rank = F.row_number().over(Window.partitionBy("_key").orderBy(severity.desc(), F.coalesce("risk_score_rule", F.lit(0.0)).desc(), "alert_id"))
        top = keyed.withColumn("_rank", rank).filter(F.col("_rank") <= c.max_alerts)
    sets = {x: F.collect_set(y) for x, y in (("alert_ids", "alert_id"), ("account_ids", "account_id"), ("customer_ids", "customer_id"), ("typologies", "typology"), ("rule_names", "rule_name"))}
    g = top.groupBy("_key").agg(F.count("*").alias("_n"), F.flatten(F.collect_list("evidence_ids")).alias("transaction_ids"), *[v.alias(k) for k, v in sets.items()])
    if account_ids is not None:
        g = g.drop("account_ids").join(account_ids, "_key", "left")
    g = g.filter(F.col("_n") >= c.min_alerts).withColumns({x: unique(F.col(x)) for x in ("alert_ids", "account_ids", "customer_ids", "transaction_ids", "typologies", "rule_names")})
    return g.select(
        ids.case_group_id(F.lit(strategy), F.col("_key"), F.col("alert_ids")).alias("case_group_id"), F.lit(strategy).alias("grouping_strategy"), F.get("account_ids", 0).alias("primary_account_id"),
        F.get("customer_ids", 0).alias("primary_customer_id"), "alert_ids", "account_ids", "customer_ids", "transaction_ids", "typologies", "rule_names", F.col("_key").alias("case_group_key"),
    )


def by_account(alerts: DataFrame, accounts: DataFrame, c: CaseConfig = CaseConfig()) -> DataFrame:
    return _grouped(with_customer(alerts, accounts).withColumn("_key", F.col("account_id")), "account", c)


def by_customer(alerts: DataFrame, accounts: DataFrame, c: CaseConfig = CaseConfig()) -> DataFrame:
    keyed = with_customer(alerts, accounts).filter(F.col("customer_id").isNotNull()).withColumn("_key", F.col("customer_id"))
    every = accounts.groupBy(F.col("customer_id").alias("_key")).agg(F.collect_set("account_id").alias("account_ids"))
    return _grouped(keyed, "customer", c, every)


def by_community(alerts: DataFrame, graph: DataFrame, c: CaseConfig = CaseConfig()) -> DataFrame:
    one = graph.groupBy("account_id").agg(F.min("community_id").cast("long").alias("_community"))
    keyed = alerts.join(one, "account_id").filter(F.col("_community").isNotNull())
    return _grouped(keyed.withColumn("_key", F.concat(F.lit("community:"), F.col("_community").cast("string"))), "graph_community", c)


def by_circular_flow(alerts: DataFrame, c: CaseConfig = CaseConfig()) -> DataFrame:
    circular = (F.regexp_replace(F.lower("typology"), " ", "_") == "circular_flow") | F.lower("rule_name").isin("circular flow", "circular_flow")
    evidence = unique(F.col("evidence_ids"))
    key = F.when(F.size(evidence) > 0, F.concat(F.lit("evidence:"), F.array_join(evidence, "|"))).otherwise(F.concat(F.lit("account:"), "account_id"))
    if "cycle_accounts" in alerts.columns:
        key = F.coalesce(F.concat(F.lit("cycle_accounts:"), F.array_join("cycle_accounts", "|")), key)
    return _grouped(alerts.filter(circular).withColumn("_key", key), "circular_flow", c)


def by_counterparty(alerts: DataFrame, transactions: DataFrame, c: CaseConfig = CaseConfig()) -> DataFrame:
    """Evidence meets transactions by id; (alert, counterparty) pairs are made distinct before the alerts rejoin."""
    evidence = alerts.select("alert_id", F.explode(unique(F.col("evidence_ids"))).alias("transaction_id"))
    pairs = evidence.join(transactions.select("transaction_id", F.col("counterparty_id").alias("_key")), "transaction_id").filter(F.col("_key").isNotNull()).select("alert_id", "_key").distinct()
    return _grouped(alerts.join(pairs, "alert_id"), "common_counterparty", c)


def case_groups(alerts: DataFrame, accounts: DataFrame, graph: DataFrame, transactions: DataFrame, c: CaseConfig = CaseConfig()) -> DataFrame:
    """All strategies' groups; of groups with one strategy and the same alerts the first id stays; then the caps."""
    made = {"account": lambda: by_account(alerts, accounts, c), "customer": lambda: by_customer(alerts, accounts, c), "graph_community": lambda: by_community(alerts, graph, c), "circular_flow": lambda: by_circular_flow(alerts, c), "common_counterparty": lambda: by_counterparty(alerts, transactions, c)}
    every = reduce(DataFrame.unionByName, [made[s]() for s in c.strategies])
    same = Window.partitionBy("grouping_strategy", F.array_join("alert_ids", "|")).orderBy("case_group_id")
    every = every.withColumn("_k", F.row_number().over(same)).filter("_k = 1")
    order = ["grouping_strategy", "case_group_id"]
    if c.max_per_account is not None:
        every = every.withColumn("_k", F.row_number().over(Window.partitionBy("primary_account_id").orderBy(*order))).filter(F.col("_k") <= c.max_per_account)
    if c.max_cases is not None:
        every = every.orderBy(F.asc_nulls_last("primary_account_id"), *order).limit(c.max_cases)
    return every.select(*GROUP_COLUMNS)


def severity_of(priority: Column) -> Column:
    return F.when(priority >= 90, "critical").when(priority >= 75, "high").when(priority >= 50, "medium").otherwise("low")


def cases_from_groups(groups: DataFrame, alerts: DataFrame, scores: DataFrame, transactions: DataFrame, c: CaseConfig = CaseConfig()) -> DataFrame:
    """One case a group: alert scores, worst account score, evidence value, priority, severity and summary."""
    keys = groups.select("case_group_id", "alert_ids", "account_ids", "transaction_ids")
    level = F.when(lookup(F.col("severity"), SEVERITY_RANK, 0) > 0, F.struct(lookup(F.col("severity"), SEVERITY_RANK, 0).alias("r"), F.lower("severity").alias("s")))
    per_alert = keys.select("case_group_id", F.explode("alert_ids").alias("alert_id")).join(alerts.dropDuplicates(["alert_id"]), "alert_id").groupBy("case_group_id").agg(
        clip_score(F.max("risk_score_rule")).alias("max_rule_risk_score"), clip_score(F.avg(F.coalesce("risk_score_rule", F.lit(0.0)))).alias("mean_rule_risk_score"), F.max(level)["s"].alias("_worst"))
    per_account = keys.select("case_group_id", F.explode("account_ids").alias("account_id")).join(scores.select("account_id", "account_risk_score"), "account_id").groupBy("case_group_id").agg(clip_score(F.max("account_risk_score")).alias("max_account_risk_score"))
    value = keys.select("case_group_id", F.explode("transaction_ids").alias("transaction_id")).join(transactions.select("transaction_id", "amount"), "transaction_id").groupBy("case_group_id").agg(F.sum("amount").alias("total_transaction_value"))
    g = groups.join(per_alert, "case_group_id").join(per_account, "case_group_id", "left").join(value, "case_group_id", "left")
    n = F.size("alert_ids")
    base = F.greatest(F.coalesce("max_account_risk_score", F.lit(0.0)), F.col("max_rule_risk_score"))
    uplift = F.least(F.lit(c.max_uplift), (n - 1) * c.uplift_per_alert)
    g = g.withColumn("priority_score", F.round(clip_score(base + uplift), 6)).withColumn("severity", F.coalesce("_worst", severity_of(F.col("priority_score"))))
    g = g.withColumns({"case_id": ids.case_id(F.col("case_group_id"), c.version), "case_version": F.lit(c.version), "alert_count": n, "unique_typology_count": F.size("typologies"), "evidence_transaction_count": F.size("transaction_ids"), "status": F.lit(c.default_status)})
    g = g.withColumns({"total_transaction_value": F.coalesce("total_transaction_value", F.lit(0).cast("decimal(28,2)")), "max_account_risk_score": F.coalesce("max_account_risk_score", F.lit(0.0))})
    summary = F.format_string("%d alerts for %s grouped by %s; %d typologies; %s severity; priority %.2f.", n, F.coalesce("primary_account_id", F.lit("unknown account")), "grouping_strategy", F.size("typologies"), "severity", "priority_score")
    return g.withColumns({"related_accounts": F.col("account_ids"), "related_customers": F.col("customer_ids"), "summary": summary}).drop("_worst", "account_ids", "customer_ids", "case_group_id")


def identified(groups: DataFrame, c: CaseConfig = CaseConfig()) -> DataFrame:
    """case_id, alert_ids: all that links cases to alerts, without what else a case has."""
    return groups.select(ids.case_id(F.col("case_group_id"), c.version).alias("case_id"), "alert_ids")


def case_alerts(cases: DataFrame) -> DataFrame:
    return cases.select("case_id", F.explode("alert_ids").alias("alert_id")).distinct()


def case_entities(cases: DataFrame) -> DataFrame:
    """case_id, entity_type, entity_id, role."""
    def part(kind: str, column: str, primary: str | None) -> DataFrame:
        e = cases.select("case_id", F.lit(kind).alias("entity_type"), F.explode(column).alias("entity_id"), (F.col(primary) if primary else F.lit(None).cast("string")).alias("_p"))
        return e.select("case_id", "entity_type", "entity_id", F.when(F.col("entity_id") == F.col("_p"), "primary").otherwise("evidence" if primary is None else "related").alias("role"))

    return part("account", "related_accounts", "primary_account_id").unionByName(part("customer", "related_customers", "primary_customer_id")).unionByName(part("transaction", "transaction_ids", None)).distinct()


@dataclass(frozen=True)
class CaseScoring:
    version: str = "composite_case_risk_v1"
    weights: dict = field(default_factory=lambda: {"alert_risk_score": 0.25, "account_risk_score": 0.25, "graph_risk_score": 0.15, "anomaly_risk_score": 0.15, "typology_diversity_score": 0.10, "evidence_value_score": 0.10})
    graph: dict = field(default_factory=lambda: {"pagerank_score": 0.25, "degree_centrality": 0.20, "cycle_count": 0.20, "community_size": 0.15})
    proximity: float = 0.20


def case_account_scores(graph: DataFrame, c: CaseScoring = CaseScoring()) -> DataFrame:
    """account_id, graph_score for case scoring; proximity is 100 / (1 + max(0, hops - 1))."""
    names = {k: f"_{k}" for k in (*c.graph, "high_risk_alert_count")}
    p = percentile_ranks(graph.select("account_id", *names, "shortest_path_to_flagged"), names)
    near = F.coalesce(100.0 / (1.0 + F.greatest(F.lit(0.0), F.col("shortest_path_to_flagged") - 1.0)), F.lit(0.0))
    total = sum((F.col(names[k]) * w for k, w in c.graph.items()), F.lit(0.0)) + (F.col(names["high_risk_alert_count"]) + near) / 2 * c.proximity
    return p.select("account_id", F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)).alias("graph_score"))


def case_components(cases: DataFrame, alerts: DataFrame, scores: DataFrame, graph: DataFrame, anomalies: DataFrame, c: CaseScoring = CaseScoring()) -> DataFrame:
    """The six components of every case. Accounts' three scores are joined once and meet the cases in one join."""
    links = case_alerts(cases).join(alerts.select("alert_id", F.coalesce("risk_score_rule", lookup(F.col("severity"), SEVERITY, 0.0)).alias("_s")).dropDuplicates(["alert_id"]), "alert_id")
    by_alert = links.groupBy("case_id").agg(clip_score(F.max("_s")).alias("max_alert_score"), clip_score(F.avg("_s")).alias("mean_alert_score"))
    best = anomalies.groupBy("account_id").agg(F.max("anomaly_score").alias("anomaly_score"))
    accounts = scores.select("account_id", "account_risk_score").join(case_account_scores(graph, c), "account_id", "full").join(best, "account_id", "full")
    members = cases.select("case_id", F.explode(unique(F.concat("related_accounts", F.array("primary_account_id")))).alias("account_id"))
    by_account = members.join(accounts, "account_id", "left").groupBy("case_id").agg(
        clip_score(F.max("account_risk_score")).alias("account_risk_score"), clip_score(F.max("graph_score")).alias("graph_risk_score"), clip_score(F.max("anomaly_score")).alias("max_anomaly_score"), clip_score(F.avg("anomaly_score")).alias("mean_anomaly_score"), F.count("*").alias("related_account_count"))
    base = cases.select("case_id", "typologies", "total_transaction_value", "evidence_transaction_count", F.size("related_accounts").alias("_related"))
    value = percentile_ranks(base, {"total_transaction_value": "_by_value", "evidence_transaction_count": "_by_evidence", "_related": "_by_related"})
    out = value.join(by_alert, "case_id", "left").join(by_account, "case_id", "left").fillna(0.0)
    return out.select(
        "case_id", (F.col("max_alert_score") * 0.7 + F.col("mean_alert_score") * 0.3).alias("alert_risk_score"), "account_risk_score", "graph_risk_score", (F.col("max_anomaly_score") * 0.75 + F.col("mean_anomaly_score") * 0.25).alias("anomaly_risk_score"),
        clip_score(F.size("typologies") * 25.0).alias("typology_diversity_score"), clip_score(F.col("_by_value") * 0.5 + F.col("_by_evidence") * 0.25 + F.col("_by_related") * 0.25).alias("evidence_value_score"), "related_account_count", "evidence_transaction_count",
    )


def case_scores(components: DataFrame, c: CaseScoring = CaseScoring()) -> DataFrame:
    total = sum((F.coalesce(k, F.lit(0.0)) * w for k, w in c.weights.items()), F.lit(0.0))
    scored = components.withColumn("case_risk_score", F.round(clip_score(total), 6))
    scored = scored.withColumns({"risk_band": band(F.col("case_risk_score")), "score_version": F.lit(c.version)})
    return global_rank(scored, [F.desc("case_risk_score"), F.asc("case_id")], "case_rank")


@dataclass(frozen=True)
class EvidenceConfig:
    version: str = "case_evidence_v1"
    #: None keeps all.
    max_alerts: int | None = 50
    max_transactions: int = 100
    max_accounts: int = 50
    high: float = 75.0
    critical: float = 90.0


def _first(frame: DataFrame, order: list[Column], most: int | None) -> DataFrame:
    placed = frame.withColumn("_k", F.row_number().over(Window.partitionBy("case_id").orderBy(*order)))
    return placed if most is None else placed.filter(F.col("_k") <= most)


def _listed(*columns: str) -> Column:
    """The rows of a case as structs, in the order of ``_k``."""
    return F.transform(F.array_sort(F.collect_list(F.struct("_k", *columns))), lambda x: F.struct(*[x[c].alias(c) for c in columns]))


def alert_evidence(cases: DataFrame, alerts: DataFrame, c: EvidenceConfig = EvidenceConfig()) -> DataFrame:
    """case_id, typology_evidence, alert_evidence: the most severe alerts of each case and what they say. Alerts of two accounts that share
    an id by chance both count."""
    a = case_alerts(cases).join(alerts.dropDuplicates(["alert_id", "account_id"]), "alert_id")
    top = _first(a, [lookup(F.col("severity"), SEVERITY_RANK, 0).desc(), F.col("risk_score_rule").desc_nulls_last(), F.col("alert_id").asc()], c.max_alerts)
    level = F.lower("severity")
    counts = F.struct(*[F.count(F.when(level == s, 1)).alias(s) for s in SEVERITY])
    return top.groupBy("case_id").agg(
        F.struct(F.array_sort(F.collect_set("typology")).alias("typologies"), F.array_sort(F.collect_set("rule_name")).alias("rule_names"), F.array_sort(F.collect_set("reason_code")).alias("reason_codes"), counts.alias("severity_counts"), F.max("risk_score_rule").alias("max_rule_risk_score"), F.avg("risk_score_rule").alias("mean_rule_risk_score")).alias("typology_evidence"),
        F.struct(F.count("*").alias("alert_count"), _listed("alert_id", "rule_name", "severity", "risk_score_rule", "reason_code", "detection_window_start").alias("alerts")).alias("alert_evidence"),
    )


def case_transactions(cases: DataFrame, transactions: DataFrame) -> DataFrame:
    return cases.select("case_id", F.explode("transaction_ids").alias("transaction_id")).join(transactions, "transaction_id")


def transaction_evidence(cases: DataFrame, transactions: DataFrame, c: EvidenceConfig = EvidenceConfig()) -> DataFrame:
    """Totals over all of a case's transactions, and the largest of them."""
    t = case_transactions(cases, transactions)
    totals = t.groupBy("case_id").agg(F.count("*").alias("n"), F.sum("amount").alias("total"), F.max("amount").alias("most"), F.min("transaction_timestamp").alias("first"), F.max("transaction_timestamp").alias("last"), F.count_distinct("counterparty_id").alias("counterparties"), F.count_distinct("destination_country").alias("countries"))
    top = _first(t, [F.col("amount").desc(), F.col("transaction_id").asc()], c.max_transactions).groupBy("case_id").agg(_listed("transaction_id", "amount", "transaction_timestamp", "transaction_type").alias("transactions"))
    return totals.join(top, "case_id").select("case_id", F.struct(F.col("n").alias("transaction_count"), F.col("total").alias("total_value"), F.col("most").alias("max_value"), F.col("first").alias("first_at"), F.col("last").alias("last_at"), F.col("counterparties").alias("counterparty_count"), F.col("countries").alias("country_count"), "transactions").alias("transaction_evidence"))


def account_evidence(cases: DataFrame, scores: DataFrame, anomalies: DataFrame, graph: DataFrame, c: EvidenceConfig = EvidenceConfig()) -> DataFrame:
    """case_id, account_evidence, graph_evidence: the riskiest accounts of each case."""
    best = anomalies.groupBy("account_id").agg(F.max("anomaly_score").alias("anomaly_score"))
    every = scores.select("account_id", "account_risk_score", "risk_band").join(best, "account_id", "left").join(graph.select("account_id", "pagerank_score", "degree_centrality", "cycle_count", "community_size", "shortest_path_to_flagged"), "account_id", "left")
    a = cases.select("case_id", F.explode("related_accounts").alias("account_id")).join(every, "account_id")
    top = _first(a, [F.col("account_risk_score").desc(), F.col("account_id").asc()], c.max_accounts)
    return top.groupBy("case_id").agg(
        F.struct(F.count("*").alias("account_count"), F.max("account_risk_score").alias("max_account_risk_score"), F.max("anomaly_score").alias("max_anomaly_score"), _listed("account_id", "account_risk_score", "risk_band", "anomaly_score").alias("accounts")).alias("account_evidence"),
        F.struct(F.max("pagerank_score").alias("max_pagerank"), F.sum("cycle_count").alias("cycles"), F.min("shortest_path_to_flagged").alias("nearest_alert"), _listed("account_id", "pagerank_score", "degree_centrality", "cycle_count").alias("accounts")).alias("graph_evidence"),
    )


def risk_drivers(scored: DataFrame, c: EvidenceConfig = EvidenceConfig()) -> DataFrame:
    """case_id, drivers: components at or above the high mark, highest first, then by name."""
    names = ("alert_risk_score", "account_risk_score", "graph_risk_score", "anomaly_risk_score", "typology_diversity_score", "evidence_value_score")
    every = F.array(*[_driver(n, F.round(F.col(n), 6), F.when(F.col(n) >= c.critical, "critical").otherwise("high"), n.replace("_", " ")) for n in names])
    return scored.select("case_id", _ordered_drivers(F.filter(every, lambda x: x["score"] >= c.high)).alias("drivers"))


def _driver(name: str, score: Column, level: Column, label: str) -> Column:
    return F.struct((-score).alias("order"), F.lit(name).alias("driver"), score.alias("score"), level.alias("level"), F.lit(label).alias("label"))


def _ordered_drivers(drivers: Column) -> Column:
    return F.transform(F.array_sort(drivers), lambda x: F.struct(x["driver"].alias("driver"), x["score"].alias("score"), x["level"].alias("level"), x["label"].alias("label")))


def evidence_drivers(dense: int = 5) -> Column:
    """A pack's drivers with those that its evidence gives, highest first, then by name. ``dense``: how many transactions
    are dense evidence."""
    high, anomaly = F.lit("high"), F.col("account_evidence.max_anomaly_score")
    severe = F.coalesce(F.col("typology_evidence.severity_counts.high") + F.col("typology_evidence.severity_counts.critical"), F.lit(0)) > 0
    found = F.array_compact(F.array(
        F.when(severe, _driver("alert_severity", F.lit(75.0), high, "high severity alerts")), F.when(F.col("transaction_evidence.transaction_count") >= dense, _driver("evidence_count", F.lit(75.0), high, "dense transaction evidence")),
        F.when(F.exists("graph_evidence.accounts", lambda x: x["cycle_count"] > 0), _driver("graph_cycles", F.lit(75.0), high, "cycle activity")), F.when(anomaly >= 75, _driver("anomaly_score", F.round(anomaly.cast("double"), 6), high, "high anomaly account")),
    ))
    own = F.transform(F.coalesce("drivers", F.array().cast("array<struct<driver:string,score:double,level:string,label:string>>")), lambda x: F.struct((-x["score"]).alias("order"), x["driver"].alias("driver"), x["score"].alias("score"), x["level"].alias("level"), x["label"].alias("label")))
    return _ordered_drivers(F.concat(own, found))


def review_focus() -> Column:
    """What an analyst is told to look at, in this order."""
    return F.array_compact(F.array(
        F.when(F.array_contains(F.transform("typology_evidence.typologies", F.lower), "circular_flow"), "Review circular flow transaction chain."),
        F.when(F.col("transaction_evidence.max_value") > 0, "Verify legitimacy of high-value counterparties."),
        F.when(F.size("graph_evidence.accounts") > 0, "Inspect graph community and proximity to flagged activity."),
        F.when(F.size("account_evidence.accounts") > 0, "Compare account activity against customer profile and account risk score."),
        F.when(F.exists("drivers", lambda x: x["driver"] == "anomaly_score"), "Review high anomaly accounts and behavioural deviation."),
        F.when(F.col("alert_evidence.alert_count") > 1, "Review repeated alerts and shared reason codes."),
    ))


def chronology(cases: DataFrame, alerts: DataFrame, transactions: DataFrame) -> DataFrame:
    """case_id, at, kind, id: alerts and transactions of each case, to be read in the order of (at, kind, id)."""
    a = case_alerts(cases).join(alerts.select("alert_id", "detection_window_start").dropDuplicates(["alert_id"]), "alert_id").select("case_id", F.col("detection_window_start").alias("at"), F.lit("alert").alias("kind"), F.col("alert_id").alias("id"))
    t = case_transactions(cases, transactions).select("case_id", ids.iso(F.col("transaction_timestamp")).alias("at"), F.lit("transaction").alias("kind"), F.col("transaction_id").alias("id"))
    return a.unionByName(t)


def evidence_packs(cases: DataFrame, alerts: DataFrame, transactions: DataFrame, scores: DataFrame, anomalies: DataFrame, graph: DataFrame, case_scores: DataFrame, c: EvidenceConfig = EvidenceConfig()) -> DataFrame:
    """One row a case with all its evidence, review focus, quality and explanation."""
    out = cases.select("case_id", "primary_account_id", "severity", "priority_score", "status", "summary")
    for part in (alert_evidence(cases, alerts, c), transaction_evidence(cases, transactions, c), account_evidence(cases, scores, anomalies, graph, c), risk_drivers(case_scores, c), case_scores.select("case_id", "case_risk_score", F.col("risk_band").alias("case_risk_band"))):
        out = out.join(part, "case_id", "left")
    out = out.withColumn("drivers", evidence_drivers())
    quality = F.struct(*[F.coalesce(F.col(x), F.lit(0)).cast("long").alias(n) for x, n in (("alert_evidence.alert_count", "alerts"), ("transaction_evidence.transaction_count", "transactions"), ("account_evidence.account_count", "accounts"))], F.col("case_risk_score").isNotNull().alias("scored"))
    out = out.withColumns({"recommended_review_focus": review_focus(), "evidence_quality": quality, "evidence_version": F.lit(c.version)})
    return out.withColumns({"explanation_text": explanation_text(), "explanation_bullets": explanation_bullets()})


def explanation_text() -> Column:
    t, d = F.col("transaction_evidence"), F.col("drivers")
    return F.concat_ws(" ", F.col("summary"), F.concat(F.lit("Typologies: "), F.array_join("typology_evidence.typologies", ", "), F.lit(".")), F.concat(t["transaction_count"].cast("string"), F.lit(" transactions worth "), t["total_value"].cast("decimal(28,2)").cast("string"), F.lit(".")), F.when(F.size(d) > 0, F.concat(F.lit("Drivers: "), F.array_join(F.transform(d, lambda x: x["driver"]), ", "), F.lit("."))))


def explanation_bullets() -> Column:
    return F.concat(F.transform("typology_evidence.reason_codes", lambda x: x), F.transform("drivers", lambda x: F.concat(x["driver"], F.lit(" is "), x["level"])))


def case_summary(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count("*").alias("case_count"), F.sum("alert_count").alias("linked_alerts"), F.max("priority_score").alias("max_priority"), F.round(F.avg("priority_score"), 6).alias("mean_priority"), F.count(F.when(F.col("severity") == "critical", 1)).alias("critical_cases"), F.count_distinct("primary_account_id").alias("account_count"))
