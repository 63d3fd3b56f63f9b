"""Account risk: five components, their weighted sum, band and rank."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.functions.analytic import band, global_rank, percentile_ranks
from tallyhound.functions.normalise import clip_score

#: Default scores and weights.
SEVERITY = {"low": 25.0, "medium": 50.0, "high": 75.0, "critical": 100.0}
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
RATING = {"low": 20.0, "medium": 50.0, "high": 80.0, "critical": 100.0, "unknown": 50.0}


@dataclass(frozen=True)
class AccountScoring:
    version: str = "composite_account_risk_v1"
    weights: dict = field(default_factory=lambda: {"rule_risk_score": 0.35, "graph_risk_score": 0.25, "anomaly_risk_score": 0.25, "customer_risk_score": 0.10, "jurisdiction_risk_score": 0.05})
    graph_weights: dict = field(default_factory=lambda: {"pagerank_percentile": 0.25, "degree_percentile": 0.15, "betweenness_percentile": 0.15, "cycle_count_percentile": 0.15, "high_risk_alert_count_percentile": 0.20, "proximity_score": 0.10})
    per_alert: float = 2.0
    high_country: float = 100.0
    standard_country: float = 30.0
    unknown_country: float = 50.0

    def __post_init__(self) -> None:
        for w in (self.weights, self.graph_weights):
            if abs(sum(w.values()) - 1) > 1e-9 or min(w.values()) < 0:
                raise ValueError("weights are non-negative and sum to one")


def lookup(value: Column, table: dict, default: float) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[F.lower(F.trim(value))], F.lit(default))


def rule_component(accounts: DataFrame, alerts: DataFrame, c: AccountScoring = AccountScoring()) -> DataFrame:
    """Largest alert score, plus a little for each further alert."""
    a = alerts.withColumn("_s", F.greatest(F.coalesce("risk_score_rule", F.lit(0.0)), lookup(F.col("severity"), SEVERITY, 0.0)))
    level = F.lower("severity")
    g = a.filter(F.trim("account_id") != "").groupBy(F.trim("account_id").alias("account_id")).agg(
        F.count("*").alias("alert_count"), F.count(F.when(level == "high", 1)).alias("high_severity_alert_count"), F.count(F.when(level == "critical", 1)).alias("critical_severity_alert_count"),
        F.max("_s").alias("max_rule_alert_score"), F.avg("_s").alias("mean_rule_alert_score"),
    )
    g = g.withColumn("rule_risk_score", clip_score(F.col("max_rule_alert_score") + (F.col("alert_count") - 1) * c.per_alert))
    full = accounts.select("account_id").join(g, "account_id", "left")
    return full.withColumns({x: F.coalesce(F.col(x), F.lit(0).cast(t)) for x, t in full.dtypes if x != "account_id"})


def proximity(hops: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 125.0 - 25.0 * hops)), F.lit(0.0))


def graph_component(accounts: DataFrame, graph: DataFrame, c: AccountScoring = AccountScoring()) -> DataFrame:
    one = graph.dropDuplicates(["account_id"])
    for name, kind in (("pagerank_score", "double"), ("degree_centrality", "double"), ("degree", "double"), ("betweenness_centrality", "double"), ("cycle_count", "double"), ("high_risk_alert_count", "double"), ("shortest_path_to_flagged", "int")):
        if name not in one.columns:
            one = one.withColumn(name, F.lit(None).cast(kind))
    degree = F.coalesce(F.when(F.col("degree_centrality") != 0, F.col("degree_centrality")), F.col("degree").cast("double"))
    one = one.withColumn("_degree", degree)
    names = {"pagerank_score": "pagerank_percentile", "_degree": "degree_percentile", "betweenness_centrality": "betweenness_percentile", "cycle_count": "cycle_count_percentile", "high_risk_alert_count": "high_risk_alert_count_percentile"}
    p = percentile_ranks(one.select("account_id", *names, "shortest_path_to_flagged"), names, single=True).withColumn("proximity_score", proximity(F.col("shortest_path_to_flagged")))
    total = sum((F.col(k) * w for k, w in c.graph_weights.items()), F.lit(0.0))
    mean = sum((F.col(k) for k in names.values()), F.lit(0.0)) / len(names)
    p = p.select("account_id", clip_score(total).alias("graph_risk_score"), mean.alias("graph_percentile_score"))
    return accounts.select("account_id").join(p, "account_id", "left").fillna(0.0)


def anomaly_component(accounts: DataFrame, anomalies: DataFrame) -> DataFrame:
    """The highest score of each account."""
    best = anomalies.groupBy("account_id").agg(F.max("anomaly_score").alias("anomaly_risk_score"))
    return accounts.select("account_id").join(best, "account_id", "left").withColumn("anomaly_risk_score", clip_score(F.col("anomaly_risk_score")))


def customer_component(accounts: DataFrame) -> DataFrame:
    rating = F.col("customer_risk_rating") if "customer_risk_rating" in accounts.columns else F.lit("unknown")
    return accounts.select("account_id", lookup(F.coalesce(rating, F.lit("unknown")), RATING, RATING["unknown"]).alias("customer_risk_score"))


def jurisdiction_component(accounts: DataFrame, exposure: DataFrame | None = None, c: AccountScoring = AccountScoring()) -> DataFrame:
    """From the share of value with high-risk countries; without it, a standard score where the country is known."""
    if exposure is None:
        known = F.coalesce(F.trim("home_country") != "", F.lit(False))
        return accounts.select("account_id", F.when(known, c.standard_country).otherwise(c.unknown_country).alias("jurisdiction_risk_score"))
    e = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("high_risk_country_exposure").cast("double")))
    e = F.when(F.col("high_risk_country_exposure").isNotNull(), e)
    score = F.coalesce(e * c.high_country + (1 - e) * c.standard_country, F.lit(c.unknown_country))
    one = exposure.groupBy("account_id").agg(F.max("high_risk_country_exposure").alias("high_risk_country_exposure"))
    return accounts.select("account_id").join(one, "account_id", "left").select("account_id", clip_score(score).alias("jurisdiction_risk_score"))


def account_components(accounts: DataFrame, alerts: DataFrame, graph: DataFrame, anomalies: DataFrame, exposure: DataFrame | None = None, c: AccountScoring = AccountScoring()) -> DataFrame:
    out = rule_component(accounts, alerts, c)
    for part in (graph_component(accounts, graph, c), anomaly_component(accounts, anomalies), customer_component(accounts), jurisdiction_component(accounts, exposure, c)):
        out = out.join(part, "account_id", "left")
    return out


def account_scores(components: DataFrame, c: AccountScoring = AccountScoring()) -> DataFrame:
    """Weighted sum (six places), band, and rank by score, then id."""
    total = sum((F.coalesce(k, F.lit(0.0)) * w for k, w in c.weights.items()), F.lit(0.0))
    scored = components.withColumn("account_risk_score", F.round(clip_score(total), 6))
    scored = scored.withColumns({"risk_band": band(F.col("account_risk_score")), "score_version": F.lit(c.version)})
    return global_rank(scored, [F.desc("account_risk_score"), F.asc("account_id")], "risk_rank")
