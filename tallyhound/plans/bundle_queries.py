"""Queries of one case's and one account's bundles, of score versions, timelines, single dates and numbered ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhound.checkpoints import checkpointed
from tallyhound.functions import ids
from tallyhound.operators import cases, features, lifecycle, read_api
from tallyhound.plans import case_queries as cq
from tallyhound.plans.evidence_queries import packs
from tallyhound.plans.sql import CTES, compose
from tallyhound.plans.table_queries import lifecycle_events
from tallyhound.sources import driver_tables as tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = compose(sql)
        return f

    return add


CTES["b_one"] = "SELECT * FROM {cs} ORDER BY case_id LIMIT 1"


@query("read_case_bundle", """
SELECT 'case' AS part, case_id AS id FROM {b_one} UNION ALL SELECT 'alerts', unnest(alert_ids) FROM {b_one} UNION ALL SELECT 'scores', case_id FROM {b_one}
UNION ALL SELECT 'entities', unnest(account_ids) FROM {b_one}""")  # fmt: skip
def _(spark, d):
    """The first case's parts. Of its entities the accounts; ``case_entity_links`` has all kinds."""
    made, alerts, _, _, scores = cq.scored_cases(spark, d)
    one = made.agg(F.min("case_id")).first()[0]
    b = read_api.case_bundle(one, made, alerts, cases.case_alerts(made), cases.case_entities(made), scores)
    part = lambda name, key, f: f.select(F.lit(name).alias("part"), F.col(key).alias("id"))
    accounts = part("entities", "entity_id", b["entities"].filter("entity_type = 'account'"))
    return part("case", "case_id", b["case"]).unionByName(part("alerts", "alert_id", b["alerts"])).unionByName(part("scores", "case_id", b["scores"])).unionByName(accounts)


@query("read_case_evidence_bundle", """
SELECT 'evidence_packs' AS part, case_id, CAST(len(alert_ids) AS BIGINT) AS alerts FROM {b_one} UNION ALL SELECT 'explanations', case_id, NULL FROM {b_one}""")  # fmt: skip
def _(spark, d):
    p = packs(spark, d)
    one = p.agg(F.min("case_id")).first()[0]
    b = read_api.case_evidence_bundle(one, p, p.select("case_id", "explanation_text"))
    of_pack = b["evidence_packs"].select(F.lit("evidence_packs").alias("part"), "case_id", F.col("alert_evidence.alert_count").cast("long").alias("alerts"))
    return of_pack.unionByName(b["explanations"].select(F.lit("explanations").alias("part"), "case_id", F.lit(None).cast("long").alias("alerts")))


def daily_features(spark, d, on: str | None = None):
    parts = (tables.event_accounts(spark, d), tables.event_transactions(spark, d), tables.countries(spark, d))
    made = features.account_features(*parts) if on is None else features.features_on(*parts, on)
    return made.withColumns({c: F.round(F.col(c) + 1e-9, 4) for c in ROUNDED})


#: Rounded on both sides before anything is compared or averaged.
ROUNDED = ("avg_txn_amount_30d", "in_out_ratio_7d", "cross_border_ratio_30d", "high_risk_country_exposure", "counterparty_entropy")


@query("feature_account_on_date", "SELECT * FROM {f_all} WHERE feature_date = (SELECT max(feature_date) FROM {f_all})")
def _(spark, d):
    """The newest date alone."""
    on = features.date_spine(tables.event_transactions(spark, d)).agg(F.max("feature_date").cast("string")).first()[0]
    return daily_features(spark, d, on).withColumn("feature_date", F.col("feature_date").cast("string")).drop("feature_version")


def _measures_sql() -> str:
    parts = [f"round({f}(CAST({c} AS DOUBLE)), 4) AS {f.replace('avg', 'mean')}_{c}" for c, fs in features.MEASURES.items() for f in ("avg", *fs)]
    return f"""SELECT count(*) AS feature_row_count, count(DISTINCT account_id) AS account_count, 1 AS feature_version_count, min(feature_date) AS min_feature_date, max(feature_date) AS max_feature_date,
  count(*) FILTER (isinf(in_out_ratio_7d)) AS infinite_in_out_ratio_count, count(*) FILTER (txn_count_7d = 0) AS zero_activity_row_count,
  count(dormant_days_before_activity) AS dormant_feature_non_null_count, {', '.join(parts)} FROM {{f_all}}"""


@query("feature_measures", _measures_sql())
def _(spark, d):
    m = features.feature_measures(daily_features(spark, d))
    return m.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c).cast("string").alias(c) if t == "date" else c for c, t in m.dtypes])


@query("read_score_versions", "SELECT o_orderpriority, count(*) AS rows, max(o_orderdate) AS latest FROM orders GROUP BY o_orderpriority")
def _(spark, d):
    return read_api.versions(tables.table(spark, d, "orders"), "o_orderpriority", "o_orderdate")


@query("read_latest_scores", """
SELECT o_custkey, o_orderdate, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_totalprice DESC NULLS LAST) = 1""")  # fmt: skip
def _(spark, d):
    """The newest order of each customer, the dearest of a day."""
    return read_api.latest_scores(tables.table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice").select("o_custkey", "o_orderdate", "o_totalprice")


@query("lifecycle_timeline", "SELECT case_id, k, to_status FROM {lc} WHERE case_id = (SELECT max(case_id) FROM {lc})")
def _(spark, d):
    e = lifecycle_events(spark, d)
    case = e.agg(F.max("case_id")).first()[0]
    return lifecycle.timeline(e, case).select("case_id", F.col("action_id").cast("long").alias("k"), "to_status")


@query("scalar_sequential_ids", "SELECT c_custkey, printf('CASE_%06d', c_custkey) AS id FROM customer")
def _(spark, d):
    return tables.table(spark, d, "customer").select("c_custkey", ids.sequential_id(" case_", F.col("c_custkey")).alias("id"))
