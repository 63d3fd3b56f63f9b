"""Rules on hand-made transactions: boundaries, ties, empty and invalid input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyhound.operators import rules
from tallyhound.sources import driver_tables as tables

SCHEMA = "transaction_id string, sender_account_id string, receiver_account_id string, counterparty_id string, transaction_timestamp timestamp_ntz, amount decimal(18,2), transaction_type string"
START = dt.datetime(2024, 1, 1, 12)


def frame(spark, rows):
    import decimal

    return spark.createDataFrame([(i, s, r, c, t, None if a is None else decimal.Decimal(a), k) for i, s, r, c, t, a, k in rows], SCHEMA)


def hours(n):
    return START + dt.timedelta(hours=n)


def accounts(spark):
    return spark.createDataFrame([("A", "C1"), ("B", "C2")], "account_id string, customer_id string")


def test_structuring_window_ends_are_inclusive(spark):
    t = frame(spark, [(f"T{k}", "a", "B", None, hours(24 if k == 7 else 0), "9500", "Transfer") for k in range(8)])
    found = rules.detect_structuring(t).collect()
    assert [(r.account_id, r.transaction_count, float(r.total_amount)) for r in found] == [("A", 8, 76000.0)]
    assert found[0].detection_window_start == "2024-01-01T12:00:00+00:00" and found[0].detection_window_end == "2024-01-02T12:00:00+00:00"
    late = frame(spark, [(f"T{k}", "A", "B", None, hours(24) + dt.timedelta(microseconds=1) if k == 7 else START, "9500", "wire") for k in range(8)])
    assert rules.detect_structuring(late).count() == 0


def test_structuring_bounds_and_score(spark):
    t = frame(spark, [(f"T{k}", "A", "B", None, hours(k), "9000" if k else "10000", "wire") for k in range(13)])
    alert = rules.structuring_alerts(t, accounts(spark)).first()
    assert alert.risk_score_rule == 90 and alert.customer_id == "C1" and alert.reason_code == "12 transfers below threshold within 24 hours"
    assert len(alert.evidence_ids) == 12 and alert.alert_id.startswith("AL_STRUCTURING_") and len(alert.alert_id) == 23


def test_fan_in_counts_distinct_senders(spark):
    t = frame(spark, [(f"T{k}", f"S{k % 15}", "A", None, hours(k), "500", "transfer") for k in range(20)])
    r = rules.detect_fan_in(t).first()
    assert (r.unique_sender_count, r.transaction_count) == (15, 20)
    assert rules.detect_fan_in(t, rules.FanIn(min_senders=16)).count() == 0


def test_fan_out_counts_counterparties_and_not_self(spark):
    t = frame(spark, [(f"T{k}", "A", None, f"P{k}", hours(k), "500", "wire") for k in range(20)] + [("X", "A", "A", None, START, "1", "wire")])
    r = rules.detect_fan_out(t).first()
    assert (r.unique_recipient_count, r.transaction_count) == (20, 20)


def test_rapid_movement_ratio_boundary(spark):
    rows = [("I", "Z", "A", None, START, "10000", "wire"), ("O", "A", "B", None, hours(48), "9000", "transfer")]
    r = rules.detect_rapid_movement(frame(spark, rows)).first()
    assert r.outflow_ratio == 0.9 and r.evidence_ids == ["I", "O"] and r.detection_window_end == "2024-01-03T12:00:00+00:00"
    less = [rows[0], ("O", "A", "B", None, hours(48), "8999.99", "transfer")]
    assert rules.detect_rapid_movement(frame(spark, less)).count() == 0


def test_dormant_needs_earlier_activity(spark):
    rows = [("P", "Z", "A", None, START, "5", "card_payment"), ("R", "A", "B", None, START + dt.timedelta(days=120), "10000", "wire")]
    r = rules.detect_dormant_reactivation(frame(spark, rows)).first()
    assert r.dormant_days_before_activity == 120 and r.evidence_ids == ["P", "R"]
    assert rules.detect_dormant_reactivation(frame(spark, rows[1:])).count() == 0


def test_cycles_are_canonical_and_direction_matters(spark):
    step = lambda i, a, b, h: (i, a, b, None, hours(h), "5000", "transfer")
    rows = [step("1", "B", "A", 0), step("2", "A", "B", 1), step("3", "C", "D", 0), step("4", "D", "E", 1), step("5", "E", "C", 2)]
    found = {r.cycle_path: r.cycle_length for r in rules.detect_circular_flow(frame(spark, rows)).collect()}
    assert found == {"A -> B -> A": 2, "C -> D -> E -> C": 3}
    late = [step("1", "A", "B", 0), step("2", "B", "A", 169)]
    assert rules.detect_circular_flow(frame(spark, late)).count() == 0


def test_empty_and_invalid_input(spark):
    empty = frame(spark, [])
    assert rules.run_rules(empty, accounts(spark)).count() == 0
    bad = frame(spark, [(None, "A", "B", None, START, "9500", "wire"), ("T", None, "B", None, START, "9500", "wire"), ("U", "A", "B", None, None, "9500", "wire"), ("V", "A", "B", None, START, "-1", "wire")])
    assert rules.normalise_transactions(bad).count() == 0
    with pytest.raises(ValueError, match="lacks"):
        rules.normalise_transactions(bad.drop("amount"))


def test_registry():
    assert rules.enabled_rules(["Fan-out", "structuring"], ["smurfing"]) == ["fan_out"]
    with pytest.raises(ValueError, match="unknown"):
        rules.rule_key("nothing")
    with pytest.raises(ValueError):
        rules.Structuring(margin=1.5)


def _hub(seed, n=1500, days=120):
    """A hub's inbound transfers over several blocks of time: clusters, equal times, repeated senders, block borders."""
    import random

    r, out = random.Random(seed), []
    for k in range(n):
        day = r.choice([r.randrange(days), r.randrange(3) * 28])
        at = dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=r.choice([0, 0, 6, r.randrange(24)]))
        out.append((f"T{k}", f"S{r.randrange(60)}", "HUB", None, at, str(r.choice([100, 250, 250, 900])), r.choice(["transfer", "wire"])))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_hub_account_over_many_blocks(spark, seed):
    rows = _hub(seed)
    width, best = dt.timedelta(days=7), None
    for at in sorted({t[4] for t in rows}):
        inside = [t for t in rows if at <= t[4] <= at + width]
        strength, total = len({t[1] for t in inside}), sum(int(t[5]) for t in inside)
        best = max(best or (0, 0, 0, 0), (strength, len(inside), total, -at.timestamp()), key=lambda x: x)
    r = rules.detect_fan_in(frame(spark, rows)).collect()
    assert [(x.unique_sender_count, x.transaction_count, int(x.total_amount)) for x in r] == [best[:3]]
    start = dt.datetime.fromisoformat(r[0].detection_window_start).timestamp()
    assert start == -best[3] - (dt.datetime(2024, 1, 1).timestamp() - dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())


def test_dormant_lookup_reaches_over_empty_blocks(spark):
    rows = [("T0", "A", "B", None, dt.datetime(2023, 1, 5), "50", "transfer")]
    rows += [(f"T{k}", "A", f"R{k}", None, dt.datetime(2024, 3, 1, k), "19000", "transfer") for k in range(1, 8)]
    r = rules.detect_dormant_reactivation(frame(spark, rows)).collect()
    assert [(x.account_id, x.dormant_days_before_activity, x.previous_activity_timestamp[:10]) for x in r] == [("A", 421, "2023-01-05")]
    assert r[0].evidence_ids[0] == "T0" and r[0].reactivation_transaction_count == 7


def test_features_of_a_hub_against_every_transaction(spark):
    """Account-day features by going over all transactions for each date: midnights, self-transfers, missing recipients."""
    import math
    import random
    from collections import Counter
    from decimal import Decimal

    from tallyhound.operators import features

    r, rows = random.Random(5), []
    for k in range(400):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(days=r.choice([0, 3, 20, r.randrange(50)]), hours=r.choice([0, 0, 9, 23]))
        sender, receiver = r.choice(["A", "B", "C"]), r.choice(["A", "B", "C", None])
        party = r.choice([None, "P1", "P2"]) if receiver is None else None
        rows.append((f"T{k}", sender, receiver, party, at, Decimal(r.choice(["9600", "20", "10000", "0"])), "transfer", r.choice([True, False, None]), r.choice(["X", "Y", None]), "Y"))
    schema = "transaction_id string, sender_account_id string, receiver_account_id string, counterparty_id string, transaction_timestamp timestamp_ntz, amount decimal(18,2), transaction_type string, is_cross_border boolean, origin_country string, destination_country string"
    accounts = spark.createDataFrame([(a,) for a in "ABCD"], "account_id string")
    countries = spark.createDataFrame([("X", 80.0, True), ("Y", None, False)], "country_code string, risk_score double, is_high_risk boolean")
    found = features.account_features(accounts, spark.createDataFrame(rows, schema), countries).collect()
    assert len({(x.account_id, x.feature_date) for x in found}) == len(found) == 4 * 50
    weight = {"X": 0.8, "Y": 0.0, None: 0.0}
    for x in found:
        day = dt.datetime.combine(x.feature_date, dt.time())
        mine = [t for t in rows if x.account_id in (t[1], t[2]) and t[4] <= day + dt.timedelta(days=1)]
        inside = lambda n: [t for t in mine if t[4] > day - dt.timedelta(days=n)]  # noqa: E731, B023
        month, week, one = inside(30), inside(7), inside(1)
        sent = lambda ts: [t for t in ts if t[1] == x.account_id]  # noqa: E731, B023
        key = lambda t: t[2] or t[3] or "<missing_recipient>"
        parties = {key(t) for t in sent(week)} | {t[1] for t in week if t[2] == x.account_id}
        counts = Counter(key(t) for t in sent(month))
        total = sum(t[5] for t in month)
        entropy = -sum(n / counts.total() * math.log(n / counts.total()) for n in counts.values())
        earlier = [t[4] for t in mine if t[4] <= day - dt.timedelta(days=1)]
        assert (x.txn_count_1d, x.txn_count_7d, x.unique_counterparties_7d) == (len(one), len(week), len(parties))
        assert (x.total_sent_7d, x.total_received_7d) == (sum(t[5] for t in sent(week)), sum(t[5] for t in week if t[2] == x.account_id))
        assert x.below_threshold_count_24h == sum(9500 <= t[5] < 10000 for t in sent(one)) and x.max_txn_amount_30d == max((t[5] for t in month), default=0)
        assert math.isclose(x.avg_txn_amount_30d, total / len(month) if month else 0, abs_tol=1e-9) and math.isclose(x.counterparty_entropy, entropy, abs_tol=1e-9)
        assert math.isclose(x.cross_border_ratio_30d, sum(bool(t[7]) for t in month) / len(month) if month else 0, abs_tol=1e-9)
        exposed = sum(float(t[5]) * max(weight[t[8]], weight[t[9]]) for t in month) / float(total) if total else 0
        assert math.isclose(x.high_risk_country_exposure, exposed, abs_tol=1e-9)
        gap = (min(t[4] for t in one).date() - max(earlier).date()).days if one and earlier else None
        assert x.dormant_days_before_activity == gap


def test_a_broken_alert_fails_the_write(spark, tmp_path):
    good = ("AL_1", "A", "Rule", "why", "high", 90.0, ["t"])
    schema = "alert_id string, account_id string, rule_name string, reason_code string, severity string, risk_score_rule double, evidence_ids array<string>"
    rules.enforced(spark.createDataFrame([good], schema)).write.parquet(str(tmp_path / "good"))
    assert spark.read.parquet(str(tmp_path / "good")).first().alert_id == "AL_1"
    broken = {"no account_id": (1, " "), "no reason_code": (3, None), "no such severity": (4, "huge"), "score beyond 0 to 100": (5, 101.0), "no evidence": (6, [])}
    for k, (problem, (at, value)) in enumerate(broken.items()):
        bad = spark.createDataFrame([good, (*good[:at], value, *good[at + 1 :])], schema)
        with pytest.raises(Exception, match=problem):
            rules.enforced(bad).write.parquet(str(tmp_path / f"bad{k}"))
        assert [r.problem for r in rules.alert_violations(bad.filter(rules.alert_problem().isNotNull())).collect()] == [problem]
    assert [r.problem for r in rules.alert_violations(spark.createDataFrame([good, good], schema)).collect()] == ["repeated alert_id"] * 2


def test_templates_of_all_reasons(spark):
    one = spark.range(1).select(
        rules.rapid_reason(F.lit(0.975), 48, "{outflow_percentage}% in {window_hours}h, {outflow_ratio}").alias("rapid"),
        rules.dormant_reason(F.lit(130), F.lit(1234.5), 7, "{dormant_days}d then {total_outbound_amount_formatted} in {reactivation_window_days}d").alias("dormant"),
        rules.circular_reason(F.lit(3), F.lit(99.0), F.lit(5.04), "{cycle_length}: {total_amount_formatted} over {time_span_hours_formatted}").alias("circular"),
        rules.circular_reason(F.lit(3), F.lit(99.0), F.lit(None).cast("double")).alias("no_span"),
    ).first()
    assert tuple(one) == ("98% in 48h, 0.975", "130d then 1234.50 in 7d", "3: 99.00 over 5.0", "3-account circular flow with 99.00 total value")


def test_orders_are_scanned_once(spark, sf):
    """Dormant and circular rules read a written table of clean rows, not the given one for each of their parts."""
    t = tables.order_transactions(spark, sf)
    for found in (rules.detect_dormant_reactivation(t), rules.detect_circular_flow(t)):
        assert found.inputFiles() and not any("orders" in f for f in found.inputFiles())


def test_counterparties_are_not_copied_to_dates(spark):
    """One account, new counterparties every day: shuffled rows follow the days and counterparties, not the dates they count for. A date on
    its own has the same features."""
    import math

    from tallyhound.operators import features

    n, days = 300, 40
    t = spark.range(n * days).select(
        F.concat(F.lit("T"), "id").alias("transaction_id"), F.lit("A").alias("sender_account_id"), F.lit(None).cast("string").alias("receiver_account_id"), F.concat(F.lit("CP"), F.col("id").cast("string")).alias("counterparty_id"),
        (F.lit("2024-01-01 12:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("id") / n).cast("int"))).alias("transaction_timestamp"), F.lit("10.00").cast("decimal(18,2)").alias("amount"), F.lit("X").alias("origin_country"), F.lit("X").alias("destination_country"), F.lit(False).alias("is_cross_border"),
    )
    accounts, countries = spark.createDataFrame([("A",)], "account_id string"), spark.createDataFrame([("X", True, 50.0)], "country_code string, is_high_risk boolean, risk_score double")
    made = features.account_features(accounts, t, countries)
    found = {str(r.feature_date): r for r in made.collect()}
    assert len(found) == days
    for k, day in enumerate(sorted(found)):
        assert found[day].unique_counterparties_7d == n * min(k + 1, 8) and abs(found[day].counterparty_entropy - math.log(n * min(k + 1, 31))) < 1e-9
    stages = made._jdf.queryExecution().executedPlan()
    assert shuffled_rows(stages) < 5 * n * days
    for date in ("2024-01-01", "2024-01-20", "2024-02-09"):
        plain = lambda r: {k: round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items()}
        assert [plain(r) for r in features.features_on(accounts, t, countries, date).collect()] == [plain(found[date])]


def shuffled_rows(plan) -> int:
    """Rows written by all shuffles of a finished adaptive plan, each exchange once."""
    seen, total, todo = set(), 0, [plan]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        elif name == "Exchange" and p.id() not in seen:
            seen.add(p.id())
            total += p.metrics().apply("shuffleRecordsWritten").value()
        todo += [p.children().apply(k) for k in range(p.children().size())]
    return total


def test_ids_shared_by_chance_are_no_invalid_alerts_of_the_query(spark, monkeypatch):
    from tallyhound.plans import rule_queries

    columns = "alert_id string, account_id string, rule_name string, reason_code string, severity string, risk_score_rule double, evidence_ids array<string>"
    alerts = spark.createDataFrame([("AL_1", "A", "R", "x", "high", 80.0, ["T1"]), ("AL_1", "B", "R", "x", "high", 80.0, ["T2"]), ("AL_2", "C", "R", "x", "odd", 80.0, ["T3"]), ("AL_3", "D", "R", "x", "low", 80.0, [])], columns)
    monkeypatch.setattr(rule_queries, "event_alerts", lambda *_: alerts)
    assert sorted(r.alert_id for r in rule_queries.QUERIES["rule_invalid_alerts"](spark, "").collect()) == ["AL_2", "AL_3"]
    assert sorted(r.alert_id for r in rules.invalid_alerts(alerts).collect()) == ["AL_1", "AL_1", "AL_2", "AL_3"]


def test_circular_alerts_of_every_cycle(spark, monkeypatch):
    from tallyhound.plans import rule_queries

    rows = []
    for k in range(520):
        rows += [(f"O{k}", "A", f"B{k:03d}", None, START + dt.timedelta(hours=k), "10000", "wire"), (f"I{k}", f"B{k:03d}", "A", None, START + dt.timedelta(hours=k + 1), "10000", "wire")]
    accounts = spark.createDataFrame([("A", "C")], "account_id string, customer_id string")
    transactions = frame(spark, rows)
    monkeypatch.setattr(rule_queries.tables, "order_transactions", lambda *_: transactions)
    monkeypatch.setattr(rule_queries.tables, "order_accounts", lambda *_: accounts)
    assert rule_queries.QUERIES["rule_circular_alerts"](spark, "").count() == 520
