"""The shortcut from silver to gold tables: relational algebra over whole-period totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.functions.analytic import global_rank, gold_band, nearest
from tallyhound.operators.scoring import SEVERITY, lookup

#: The days that totals are spread over, and the ratio where nothing was received.
ACTIVE_DAYS, PERIOD_DAYS, RATIO_CAP = 13.0, 90.0, 999_999.0


def features(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    """Totals of both sides by account, spread over the period."""
    def side(me: str, other: str, name: str) -> DataFrame:
        return transactions.filter(F.col(me).isNotNull()).groupBy(F.col(me).alias("account_id")).agg(F.count("*").alias(f"{name}_count"), F.sum("amount").cast("double").alias(f"{name}_total"), F.avg("amount").cast("double").alias(f"{name}_avg"), F.max("amount").cast("double").alias(f"{name}_max"), (F.count_distinct(other) + F.max(F.col(other).isNull().cast("int"))).alias(f"{name}_others"))

    f = accounts.select("account_id").join(side("sender_account_id", "receiver_account_id", "sent"), "account_id", "left").join(side("receiver_account_id", "sender_account_id", "received"), "account_id", "left")
    f = f.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(t)) for c, t in f.dtypes if c != "account_id"})
    n, week = F.col("sent_count") + F.col("received_count"), 7.0 / PERIOD_DAYS
    return f.select(
        "account_id", n.alias("txn_count_total"), nearest(n / ACTIVE_DAYS, 2).alias("txn_count_1d"), nearest(n * 7.0 / PERIOD_DAYS, 2).alias("txn_count_7d"), nearest(F.col("sent_total") * week, 2).alias("total_sent_7d"), nearest(F.col("received_total") * week, 2).alias("total_received_7d"),
        nearest(F.when(F.col("sent_avg") > 0, F.col("sent_avg")).otherwise(F.col("received_avg")), 2).alias("avg_txn_amount_30d"), nearest(F.greatest("sent_max", "received_max"), 2).alias("max_txn_amount_30d"), F.col("sent_others").alias("unique_counterparties_7d"),
        nearest(F.when(F.col("received_total") > 0, F.col("sent_total") / F.col("received_total")).otherwise(RATIO_CAP), 4).alias("in_out_ratio_7d"), nearest(F.col("received_total") - F.col("sent_total"), 2).alias("retained_balance_proxy"),
    )


def graph_features(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    """Degrees, and degree over the largest."""
    ends = transactions.select(F.explode(F.array(F.struct(F.col("sender_account_id").alias("a"), F.lit(1).alias("o")), F.struct(F.col("receiver_account_id").alias("a"), F.lit(0).alias("o")))).alias("e")).select("e.*").filter("a IS NOT NULL")
    d = ends.groupBy(F.col("a").alias("account_id")).agg(F.sum("o").alias("out_degree"), F.sum(1 - F.col("o")).alias("in_degree"), F.count("*").alias("degree_total"))
    full = accounts.select("account_id").join(d, "account_id", "left").fillna(0)
    most = F.broadcast(full.agg(F.greatest(F.max("degree_total"), F.lit(1)).alias("_m")))
    return full.crossJoin(most).withColumn("degree_share", nearest(F.col("degree_total") / F.col("_m"), 6)).drop("_m")


def bucket(column: str, n: int):
    """A stable remainder of an id, the same on every engine: hex digits of its SHA-256."""
    return F.pmod(F.conv(F.substring(F.sha2(F.col(column), 256), 1, 8), 16, 10).cast("long"), F.lit(n))


def anomaly_scores(features: DataFrame, flagged: DataFrame) -> DataFrame:
    """Activity share, membership of ``flagged`` accounts, and a stable spread by id."""
    f = features.join(flagged.select("account_id", F.lit(True).alias("_flag")).distinct(), "account_id", "left")
    most = F.broadcast(features.agg(F.greatest(F.max("txn_count_total"), F.lit(1)).alias("_m")))
    score = F.col("txn_count_total") / F.col("_m") * 45.0 + F.when(F.col("_flag"), 45.0).otherwise(0.0) + bucket("account_id", 10)
    s = f.crossJoin(most).select("account_id", nearest(score, 2).alias("anomaly_score"))
    s = s.withColumns({"is_anomaly": F.col("anomaly_score") >= 70, "risk_band": gold_band(F.col("anomaly_score"))})
    return global_rank(s, [F.desc("anomaly_score"), F.asc("account_id")], "anomaly_rank")


def account_risk(anomaly: DataFrame, graph: DataFrame, flagged: DataFrame) -> DataFrame:
    a = anomaly.select("account_id", F.col("anomaly_score").alias("anomaly_component")).join(graph.select("account_id", "degree_total"), "account_id", "left").join(flagged.select("account_id", F.lit(True).alias("_flag")).distinct(), "account_id", "left")
    most = F.broadcast(graph.agg(F.greatest(F.max("degree_total"), F.lit(1)).alias("_m")))
    a = a.crossJoin(most).withColumns({"graph_risk_component": nearest(F.coalesce("degree_total", F.lit(0)) / F.col("_m") * 100, 2), "rule_risk_component": F.when(F.col("_flag"), 85.0).otherwise(15.0)})
    a = a.withColumn("account_risk_score", nearest(F.col("anomaly_component") * 0.4 + F.col("graph_risk_component") * 0.25 + F.col("rule_risk_component") * 0.35, 2))
    a = a.withColumn("risk_band", gold_band(F.col("account_risk_score"))).drop("_flag", "_m", "degree_total")
    return global_rank(a, [F.desc("account_risk_score"), F.asc("account_id")], "risk_rank")


def alerts_from_manifest(manifest: DataFrame) -> DataFrame:
    """One alert a scenario: lists are split, severity gives the score."""
    ids = F.split("evidence_transaction_ids", r"\s*[,;|]\s*")
    return manifest.select(F.concat(F.lit("AL_"), F.upper(F.substring(F.sha1(F.col("scenario_id").cast("binary")), 1, 10))).alias("alert_id"), F.col("primary_account_id").alias("account_id"), "typology", F.lower("expected_severity").alias("severity"), lookup(F.col("expected_severity"), SEVERITY, 50.0).alias("risk_score_rule"), ids.alias("evidence_ids"), F.size(ids).alias("evidence_count"))


def cases(alerts: DataFrame) -> DataFrame:
    """One case an account. The main typology is the most frequent; ties go to the more severe, then by name."""
    rank = lookup(F.col("severity"), {"low": 1, "medium": 2, "high": 3, "critical": 4}, 0)
    per = alerts.groupBy("account_id", "typology").agg(F.count("*").alias("n"), F.max(rank).alias("r"), F.max("risk_score_rule").alias("mx"), F.sum("risk_score_rule").alias("sm"))
    g = per.groupBy("account_id").agg(F.sum("n").alias("alert_count"), F.count("*").alias("typology_count"), F.min(F.struct(-F.col("n"), -F.col("r"), F.col("typology")))["typology"].alias("main_typology"), F.max("mx").alias("max_alert_score"), (F.sum("sm") / F.sum("n")).alias("mean_alert_score"))
    return g.withColumns({"case_id": F.concat(F.lit("CASE_"), F.upper(F.substring(F.sha1(F.col("account_id").cast("binary")), 1, 10))), "status": F.lit("New"), "assigned_to": F.concat(F.lit("analyst_"), (bucket("account_id", 5) + 1).cast("string"))})


#: Added before rounding, so that halves go up whatever the order of the sums.
HALF_UP = 1e-9


def case_risk(cases: DataFrame, risk: DataFrame) -> DataFrame:
    c = cases.join(risk.select("account_id", F.col("account_risk_score").alias("account_component")), "account_id", "left").fillna(0.0, ["account_component"])
    score = F.col("max_alert_score") * 0.5 + F.col("account_component") * 0.3 + F.col("typology_count") * 5.0 + F.col("alert_count") * 1.5
    c = c.select("case_id", "max_alert_score", "account_component", "typology_count", nearest(score + HALF_UP, 2).alias("case_risk_score"))
    return global_rank(c.withColumn("risk_band", gold_band(F.col("case_risk_score"))), [F.desc("case_risk_score"), F.asc("case_id")], "risk_rank")
