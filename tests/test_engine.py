"""Operators beside the rules, on small frames."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyhound.checkpoints import checkpointed
from tallyhound.functions import analytic, normalise
from tallyhound.functions.analytic import global_rank, percentile_ranks
from tallyhound.operators import graph, lifecycle, models, read_api, rules, security, staging
from tallyhound.sources import files


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def test_percentiles_share_ranks(spark):
    f = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", None)], "k string, v double")
    got = {r.k: r.p for r in percentile_ranks(f, {"v": "p"}).collect()}
    assert got == {"d": 25.0, "a": 50.0, "b": 87.5, "c": 87.5}
    one = spark.createDataFrame([("a", 3.0)], "k string, v double")
    assert percentile_ranks(one, {"v": "p"}, single=True).first().p == 100


def test_global_rank_is_total(spark):
    f = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = global_rank(f, [F.desc("v"), F.asc("id")], "r").orderBy("r").collect()
    assert [r.r for r in got] == list(range(1, 1001)) and got == sorted(got, key=lambda r: (-r.v, r.id))


def test_components_clustering_betweenness(spark):
    e = edges(spark, ("A", "B"), ("B", "C"), ("C", "A"), ("X", "Y"))
    roots = {r.id: r.root for r in graph.component_roots(e).collect()}
    assert roots == {"A": "A", "B": "A", "C": "A", "X": "X", "Y": "X"}
    acc = spark.createDataFrame([("A",), ("X",), ("Q",)], "account_id string")
    assert {r.account_id: r.clustering_coefficient for r in graph.clustering(e, acc).collect()} == {"A": 1.0, "X": 0.0, "Q": 0.0}
    line = edges(spark, ("A", "B"), ("B", "C"))
    assert {r.account_id: r.betweenness_centrality for r in graph.betweenness(line).collect()} == {"A": 0.0, "B": 0.5, "C": 0.0}
    assert sum(r.pagerank_score for r in graph.pagerank(e, rounds=5).collect()) == pytest.approx(1)


def test_modularity_splits_two_cliques(spark):
    clique = lambda p: [(f"{p}{a}", f"{p}{b}") for a in range(4) for b in range(a)]
    got = {r.account_id: r.community_id for r in graph.greedy_modularity(edges(spark, *clique("a"), *clique("b"), ("a0", "b0"))).collect()}
    assert len(set(got.values())) == 2 and len({got[f"a{k}"] for k in range(4)}) == 1


def test_normalisers(spark):
    r = spark.createDataFrame([(" ab  c ", "yes", "nan", "2024-01-02T03:04:05")], "a string, b string, c string, d string")
    row = r.select(normalise.identifier(F.col("a"), "X_").alias("a"), normalise.boolean(F.col("b")).alias("b"), normalise.number(F.col("c"), 1.5).alias("c"), normalise.timestamp(F.col("d")).alias("d"), normalise.timestamp(F.col("a")).alias("e"), normalise.pg_array(F.lit('{b,"a",a}')).alias("f")).first()
    assert tuple(row) == ("X_AB_C", True, 1.5, dt.datetime(2024, 1, 2, 3, 4, 5), None, ["a", "b"])


def test_lifecycle(spark):
    none = spark.createDataFrame([], "case_id string, action_type string, from_status string, to_status string, analyst_id string, decision_reason string, comment string, action_timestamp timestamp_ntz, action_id string")
    one = lifecycle.append_action(none, "K", "status_change", "Escalated", at="2024-01-01 00:00:00")
    two = lifecycle.append_action(one, "K", "status_change", "Closed suspicious", reason="r", comment="c", at="2024-01-02 00:00:00")
    assert lifecycle.current_state(two).first().status == "Closed suspicious"
    with pytest.raises(ValueError, match="can't go"):
        lifecycle.append_action(two, "K", "status_change", "In review")
    with pytest.raises(ValueError, match="closure"):
        lifecycle.append_action(one, "K", "status_change", "Closed suspicious")


def test_assignment_and_comment(spark):
    none = spark.createDataFrame([], "case_id string, action_type string, from_status string, to_status string, analyst_id string, decision_reason string, comment string, action_timestamp timestamp_ntz, action_id string")
    one = lifecycle.assign(none, "K", "ann", at="2024-01-01 00:00:00")
    two = lifecycle.assign(one, "K", queue="tier two", at="2024-01-01 00:00:00")
    three = lifecycle.append_action(two, "K", "comment", comment="seen", at="2024-01-02 00:00:00")
    rows = three.collect()
    assert len({r.action_id for r in rows}) == 3 and all(r.action_id.startswith("CASE_ACTION_") for r in rows)
    payload = json.dumps({"case_id": "K", "action_type": "assign", "analyst_id": "local_analyst", "from_status": "New", "to_status": None, "assigned_to": "ann", "queue": None, "decision_reason": None, "comment": None, "metadata": {}, "action_timestamp": "2024-01-01T00:00:00+00:00"}, sort_keys=True)
    assert rows[0].action_id == "CASE_ACTION_" + hashlib.sha256(payload.encode()).hexdigest()[:16].upper()
    assert lifecycle.current_state(three).first().assigned_to == "ann"
    for bad in ({"kind": "assign"}, {"kind": "comment", "comment": " "}):
        with pytest.raises(ValueError, match="an assignment|a comment"):
            lifecycle.append_action(none, "K", **bad)


def test_labels_are_checked(spark):
    events = spark.createDataFrame([("K", "status_change", "Closed suspicious", None, "c", "2024-01-01 00:00:00", "1", "ana")], "case_id string, action_type string, to_status string, decision_reason string, comment string, at string, action_id string, analyst_id string")
    events = events.withColumn("action_timestamp", F.col("at").cast("timestamp_ntz"))
    made = spark.createDataFrame([("K", "A", "2024-02-01 00:00:00")], "case_id string, primary_account_id string, at string").withColumn("created_at", F.col("at").cast("timestamp_ntz"))
    assert {r.problem for r in lifecycle.label_violations(made, events).collect()} == {"a closure label needs a reason", "the label is before the case"}
    assert lifecycle.case_labels(made, events).count() == 1
    with pytest.raises(ValueError, match="K: "):
        lifecycle.case_labels(made, events, enforce=True)


def test_security(spark):
    f = spark.createDataFrame([("ACC_12345", "Ann", "T123456", 1), (None, None, "abc", 2), ("x", "y", "", 3)], "account_id string, customer_name string, transaction_id string, n int")
    masked = [tuple(r) for r in security.mask_frame(f).orderBy("n").collect()]
    digest = hashlib.sha256(b"local_dev_salt|ACC_12345").hexdigest()
    assert masked[:2] == [(digest, "[REDACTED]", "****3456", 1), (None, None, "****abc", 2)] and masked[2][2] == "[REDACTED]"
    assert security.export(f, "viewer").count() == 3
    for bad in ({"sensitive": True, "role": "senior_analyst"}, {"sensitive": True, "sensitive_allowed": True, "role": "analyst"}, {"role": "guest"}):
        with pytest.raises(PermissionError):
            security.export(f, **bad)
    with pytest.raises(ValueError, match="at most 2"):
        security.export(f, "viewer", most_rows=2)
    assert security.export(f, "admin", sensitive=True, sensitive_allowed=True).first().account_id is not None


def test_forest_takes_nulls_and_split_is_even(spark):
    f = spark.range(300).select(F.col("id").cast("string").alias("account_id"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id").cast("double")).alias("x"), F.lit(float("nan")).alias("y"), (F.col("id") % 2).cast("int").alias("label"))
    assert models.isolation_forest(f, ("x", "y"), trees=10).count() == 300
    held = models.split_stratified(f, "label", "account_id").groupBy("label").agg(F.count_if("is_validation").alias("n")).collect()
    assert {r.n for r in held} == {38}


def test_pagerank_converges(spark):
    pairs = [(k, (k * 7 + j * 3) % 23) for k in range(23) for j in range(1, 4) if k % 5]
    got = {r.account_id: r.pagerank_score for r in graph.pagerank(spark.createDataFrame([(f"A{a}", f"A{b}") for a, b in pairs], "src string, dst string").distinct()).collect()}
    out = {a: {b for x, b in pairs if x == a} for a in range(23)}
    rank = [1 / 23] * 23
    for _ in range(300):
        lost = sum(rank[a] for a in range(23) if not out[a])
        rank = [0.15 / 23 + 0.85 * (sum(rank[a] / len(out[a]) for a in range(23) if b in out[a]) + lost / 23) for b in range(23)]
    assert all(got[f"A{k}"] == pytest.approx(rank[k], abs=1e-5) for k in range(23))


def test_customer_of_the_last_account_row(spark):
    a = spark.createDataFrame([("A1", "C9", 1), ("A1", "C2", 2)], "account_id string, customer_id string, raw_record_id int")
    d = spark.createDataFrame([("A1",)], "account_id string")
    assert rules.attach_customers(d, a).first().customer_id == "C2"


def test_reason_templates(spark):
    r = spark.range(1).select(rules.count_reason(F.lit(3), "senders", 7, "days", "{count} of {unit_label} in {window_value} {window_unit}!").alias("r")).first().r
    assert r == "3 of senders in 7 days!"


def test_whole_orders_are_never_one_task(spark):
    """No window without partition keys over rows: what is ordered whole is one row a range."""
    f = spark.range(5000).select(F.col("id").cast("string").alias("account_id"), (F.col("id") % 977).cast("double").alias("x"), F.rand(1).alias("y"))
    got = analytic.percentile_ranks(f, {"x": "px", "y": "py"})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan  # ranks are written before they are joined
    x = sorted((i % 977) for i in range(5000))
    first = {v: x.index(v) for v in (0, 500, 976)}
    for r in got.filter("x IN (0, 500, 976)").dropDuplicates(["x"]).collect():
        n = x.count(int(r.x))
        assert r.px == pytest.approx((first[int(r.x)] + (n + 1) / 2) / 5000 * 100)


def test_read_and_limits(spark):
    f = spark.createDataFrame([("a%b",), ("acb",)], "t string")
    assert read_api.contains_any(f, "A%B", ["t"]).count() == 1
    with pytest.raises(ValueError, match="negative"):
        read_api.read(f, limit=-1)


def test_metrics_and_models(spark):
    s = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 0), (3, 0.7, 1), (4, 0.1, 0)], "id int, score double, label int")
    m = models.curve_metrics(s).first()
    assert m.roc_auc == pytest.approx(0.75) and m.pr_auc == pytest.approx((1 + 2 / 3) / 2)
    assert models.curve_metrics(s.filter("label = 1")).first().roc_auc is None
    assert models.train_supervised(s.filter("label = 1"), ["score"]) == 1.0
    iso = spark.createDataFrame([(str(k), float(k % 10), 1.0) for k in range(200)] + [("odd", 500.0, 90.0)], "account_id string, a double, b double")
    assert models.isolation_forest(iso, ("a", "b"), trees=30).orderBy("anomaly_rank").first().account_id == "odd"


def test_files_and_staging(spark, tmp_path):
    for t in files.CORE:
        (tmp_path / f"{t}.csv").write_text("country_code,score\nus,1\n")
    assert files.bronze_to_silver(spark, str(tmp_path), str(tmp_path / "silver")) == 6
    assert set(files.silver_paths(spark, str(tmp_path / "silver"))) == set(files.CORE)
    with pytest.raises(FileNotFoundError):
        files.bronze_to_silver(spark, str(tmp_path / "none"), str(tmp_path / "x"))
    with pytest.raises(ValueError, match="no reader"):
        files.read_table_file(spark, "x.txt")
    raw = files.read_table_file(spark, str(tmp_path / "countries.csv"))
    assert staging.countries(raw).first().country_code == "US"
    assert files.export_gold(spark, {"a": raw, "b": None}, str(tmp_path / "gold")) == {"a": 1, "b": -1}


def test_streaming_counts_match_batch(spark, tmp_path):
    from tallyhound.streaming.rules import near_threshold_counts, transaction_stream

    rows = [(f"T{k}", "A", dt.datetime(2024, 1, 1, k), 9500.0, "wire") for k in range(5)]
    schema = "transaction_id string, sender_account_id string, transaction_timestamp timestamp_ntz, amount double, transaction_type string"
    spark.createDataFrame([*rows, rows[0]], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    counts = near_threshold_counts(transaction_stream(spark, str(tmp_path / "in"), schema), slide="24 hours")
    q = counts.writeStream.format("memory").queryName("near").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("near").agg(F.sum("transaction_count")).first()[0] == 5


def test_zero_amounts_as_the_sql_has_them(spark, tmp_path):
    """Events of amount zero are members of windows for the SQL; the rules leave them out unless they are asked for."""
    import shutil

    import oracle
    from tallyhound.operators import rules
    from tallyhound.plans import ALL_QUERIES, ALL_SQL
    from tallyhound.plans.rule_queries import FAN_IN
    from tallyhound.sources import driver_tables

    for t in oracle.TABLES:
        if t != "events":
            shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path)
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.withColumn("value", F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.col("value"))).write.parquet(str(tmp_path / "events.parquet"))
    db = oracle.views(str(tmp_path))
    for name in ("rule_fan_in_candidates", "rule_rapid_candidates", "rule_engine_alerts"):
        assert not oracle.difference(ALL_QUERIES[name](spark, str(tmp_path)), ALL_SQL[name], db)
    assert not rules.fan_in_candidates(driver_tables.event_transactions(spark, str(tmp_path)), FAN_IN).filter("amount = 0").count()


def test_rounding_as_the_sql_has_it(spark):
    from tallyhound.plans.case_queries import nearest

    values = [69.72625, 1.00005, 2.5, 0.00015, 88.57495]
    import duckdb

    got = [r[0] for r in spark.createDataFrame([(v, i) for i, v in enumerate(values)], "x double, i int").orderBy("i").select(nearest("x", 4)).collect()]
    assert got == [duckdb.connect().execute(f"SELECT round({v!r}::DOUBLE, 4)").fetchone()[0] for v in values]


def test_alerts_and_movements_make_no_cases(spark, sf, monkeypatch):
    from tallyhound.plans import read_queries

    def none(*_):
        raise AssertionError("cases were made")

    monkeypatch.setattr(read_queries.cq, "made_cases", none)
    assert read_queries.QUERIES["read_account_alerts_and_movements"](spark, sf).columns == ["part", "id"]


@pytest.mark.parametrize("model", ["logistic_regression", "random_forest"])
def test_fitted_models_score_after_an_observed_write(spark, model):
    frame = checkpointed(spark.createDataFrame([(f"C{k:02d}", float(k), k % 3 / 2, int(k + k % 4 > 20)) for k in range(40)], "case_id string, a double, b double, label int"))
    got = models.score_supervised(models.train_supervised(frame, ["a", "b"], model=model), frame, ["a", "b"], "case_id").collect()
    score = {r.case_id: r.score for r in got}
    assert len(got) == 40 and sorted(r.score_rank for r in got) == list(range(1, 41))
    assert score["C39"] > 0.9 > 0.1 > score["C00"]


def test_gold_rounds_as_its_sql(spark):
    import duckdb

    from tallyhound.operators import gold

    n = 400
    anomaly = spark.range(n).select(F.col("id").cast("string").alias("account_id"), (F.col("id") / 20 + 6.55).alias("anomaly_score"))
    degrees = spark.range(n).select(F.col("id").cast("string").alias("account_id"), (F.col("id") * 7 % 300).alias("degree_total"))
    got = {int(r.account_id): (r.graph_risk_component, r.account_risk_score) for r in gold.account_risk(anomaly, degrees, anomaly.limit(0)).collect()}
    sql = f"SELECT id, g, round(a * 0.4 + g * 0.25 + 15.0::DOUBLE * 0.35, 2) FROM (SELECT id, id / 20 + 6.55::DOUBLE AS a, round(id * 7 % 300 / 299 * 100, 2) AS g FROM range({n}) t(id))"
    assert got == {i: (g, s) for i, g, s in duckdb.connect().execute(sql).fetchall()}


def test_alert_evidence_of_every_group_and_alert(spark, monkeypatch):
    from tallyhound.plans import case_queries

    columns = "alert_id string, account_id string, customer_id string, rule_name string, typology string, severity string, risk_score_rule double, reason_code string, evidence_ids array<string>, detection_window_start string"
    alerts = spark.createDataFrame([(f"AL_{k:04d}", f"ACC_{k % 700}", None, "R", "fan_in", "high", 80.0, "x", ["T1"], "") for k in range(1400)], columns)
    accounts = spark.createDataFrame([(f"ACC_{k}", "CUST_1") for k in range(700)], "account_id string, customer_id string")
    nodes = accounts.select("account_id", F.pmod(F.substring("account_id", 5, 9).cast("int"), F.lit(2)).alias("community_id"))
    transactions = spark.createDataFrame([("T1", "CP_1")], "transaction_id string, counterparty_id string")
    monkeypatch.setattr(case_queries, "event_alerts", lambda *_: alerts)
    monkeypatch.setattr(case_queries, "graph_inputs", lambda *_: nodes)
    monkeypatch.setattr(case_queries.tables, "event_accounts", lambda *_: accounts)
    monkeypatch.setattr(case_queries.tables, "event_transactions", lambda *_: transactions)
    got = sorted(r.alert_count for r in case_queries.QUERIES["case_alert_evidence"](spark, "").collect())
    # an account, a customer, two communities and a counterparty
    assert got == [2] * 700 + [700, 700, 1400, 1400]
