"""Stored versions: transactions, lost races, upserts by bucket; case actions and ingest on them."""

import pytest
from pyspark.sql import functions as F

from tallyhound.operators import ingest, lifecycle_store
from tallyhound.plans.store_queries import silver
from tallyhound.sources.versioned import LostRace, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_changes_land_together_or_not_at_all(spark, store):
    pairs = lambda *x: spark.createDataFrame(x, "k long, v string, w long")
    one = store.begin()
    assert one.append("log", spark.createDataFrame([("a",), ("b",)], "x string"))["rows"] == 2
    one.upsert("t", pairs((1, "a", 1), (2, "b", 2), (None, "n", 3)), ["k"])
    assert store.newest() == 0 and store.tables() == []  # nothing is seen before the commit
    with pytest.raises(KeyError):
        store.read("t")
    assert one.commit("first") == 1 and store.tables() == ["log", "t"]
    mine, other = store.begin(), store.begin()
    mine.append("log", spark.createDataFrame([("c",)], "x string"))
    counts = mine.upsert("t", spark.createDataFrame([(2, 20), (9, 90), (None, 30)], "k long, w long"), ["k"])
    assert counts["touched"] <= 3
    other.append("log", spark.createDataFrame([("lost",)], "x string"))
    mine.commit()
    with pytest.raises(LostRace):
        other.commit()
    assert rows(store.read("log")) == [("a",), ("b",), ("c",)]
    assert rows(store.read("t")) == [(1, "a", 1), (2, "b", 20), (9, None, 90), (None, "n", 30)]
    assert rows(store.read("t", 1)) == [(1, "a", 1), (2, "b", 2), (None, "n", 3)]  # older versions stay readable
    assert store.manifest()["tables"]["t"]["rows"] == 4 and store.manifest()["tables"]["log"]["rows"] == 3
    bad = store.begin()
    with pytest.raises(ValueError, match="two rows"):
        bad.upsert("t", pairs((5, "x", 1), (5, "y", 1)), ["k"])
    with pytest.raises(ValueError, match="has the keys"):
        bad.upsert("t", pairs((5, "x", 1)), ["v"])
    with pytest.raises(ValueError, match="has no z"):
        bad.upsert("t", pairs((5, "x", 1)).withColumnRenamed("v", "z"), ["k"])
    with pytest.raises(ValueError, match="has keys"):
        bad.append("t", pairs((5, "x", 1)))
    assert store.vacuum(keep=1) >= 1 and rows(store.read("t")) == [(1, "a", 1), (2, "b", 20), (9, None, 90), (None, "n", 30)]


def test_only_touched_buckets_are_written(spark, store):
    change = store.begin()
    change.upsert("t", spark.range(2000).select(F.col("id").alias("k"), F.lit(0).alias("v")), ["k"])
    change.commit()
    before = store.manifest()["tables"]["t"]["parts"]
    change = store.begin()
    seen = change.upsert("t", spark.createDataFrame([(7, 1)], "k long, v int"), ["k"])
    change.commit()
    after = store.manifest()["tables"]["t"]["parts"]
    assert seen["touched"] == 1 and sum(before[b] != after[b] for b in before) == 1 and seen["rows"] < 200
    assert store.read("t").agg(F.count("*"), F.sum("v")).first() == (2000, 1)


ACTION = "case_id string, action_type string, to_status string, analyst_id string, decision_reason string, comment string, assigned_to string, queue string, action_timestamp string"


def act(spark, *actions):
    return spark.createDataFrame([(*a, *([None] * (8 - len(a))), f"2024-01-0{k + 1} 00:00:00") for k, a in enumerate(actions)], ACTION)


def test_actions_change_events_snapshot_and_assignments_together(spark, store):
    lifecycle_store.open_cases(store, spark.createDataFrame([("c1", 5), ("c2", 6)], "case_id string, score int"))
    version = lifecycle_store.apply_actions(store, act(spark, ("c1", "status_change", "In review", "ann"), ("c1", "assign", None, "ann", None, None, "bob", "q1"), ("c1", "status_change", "Closed suspicious", "bob", "why", "text"), ("c2", "comment", None, "ann", None, "hm")))
    assert version == 2
    assert rows(store.read("cases").select("case_id", "score", "status", "assigned_to", "queue")) == [("c1", 5, "Closed suspicious", "bob", "q1"), ("c2", 6, "New", None, None)]
    assert rows(store.read("case_events").select("case_id", "from_status", "to_status")) == [("c1", "In review", "Closed suspicious"), ("c1", "In review", None), ("c1", "New", "In review"), ("c2", "New", None)]
    assert rows(store.read("case_assignments").select("case_id", "assigned_to", "assigned_by")) == [("c1", "bob", "ann")]
    assert store.read("case_events").filter("action_id LIKE 'CASE_ACTION_%'").select("action_id").distinct().count() == 4
    lifecycle_store.apply_actions(store, act(spark, ("c1", "assign", None, "eve", None, None, "eve")))
    assert rows(store.read("case_assignments").select("assigned_to", "queue", "assigned_by")) == [("eve", None, "eve")]
    for bad in (
        [("c1", "status_change", "In review", "ann")],  # closed cases can only be archived
        [("c2", "status_change", "Closed suspicious", "ann")],  # no reason
        [("c2", "status_change", "In review", "ann"), ("c2", "status_change", "New", "ann")],
        [("c9", "comment", None, "ann", None, "x")], [("c2", "comment", None, "ann")], [("c2", "assign", None, "ann")], [("c2", "other", None, "ann")], [("c2", "comment", None, " ", None, "x")],
    ):
        with pytest.raises(ValueError, match="can't be applied"):
            lifecycle_store.apply_actions(store, act(spark, *bad))
    assert store.newest() == 3 and store.read("case_events").count() == 5


def test_ingest_and_staging_are_counted_as_they_are_written(spark, sf, store):
    tables = silver(spark, sf)
    with pytest.raises(FileNotFoundError, match="devices"):
        ingest.ingest_raw(store, {t: f for t, f in tables.items() if t != "devices"})
    extra = tables["devices"].unionByName(spark.createDataFrame([(None,), ("DEV_1",)], "device_id string"))
    ingest.ingest_raw(store, tables | {"devices": extra}, run_id="r1")
    audit = {r.table_name: r for r in store.read("audit_events").collect()}
    assert audit["raw_devices"].row_count == extra.count() and audit["raw_devices"].missing_keys == 1 and audit["raw_accounts"].missing_keys == 0
    ids = [r.raw_record_id for r in ingest.read_raw(store, "devices").collect()]
    assert len(set(ids)) == len(ids) and [r.raw_record_id for r in ingest.read_raw(store, "devices", 3).collect()] == sorted(ids)[:3]
    for bad in (lambda: ingest.read_raw(store, "users"), lambda: ingest.read_raw(store, "devices", -1)):
        with pytest.raises(ValueError, match="no raw table|negative"):
            bad()
    ingest.stage_raw(store, validate=False, run_id="r2")
    assert store.read("stg_devices").count() == tables["devices"].count()
    newer = tables["countries"].limit(1).withColumn("country_name", F.lit("Renamed"))
    ingest.ingest_raw(store, {t: (newer if t == "countries" else f.limit(0)) for t, f in tables.items()}, run_id="r3")
    before = store.newest()
    with pytest.raises(ValueError, match="orphan_senders: [0-9]+ violations"):
        gone = {t: (f.limit(0) if t == "accounts" else f) for t, f in tables.items()}
        other = Store(spark, store.root + "-other")
        ingest.ingest_raw(other, gone)
        ingest.stage_raw(other)
    ingest.stage_raw(store, validate=False, run_id="r4")
    assert store.newest() == before + 1 and store.read("stg_countries").filter("country_name = 'Renamed'").count() == 1
    assert store.read("stg_countries").count() == tables["countries"].count()
    assert store.read("audit_events").filter("stage = 'staging'").count() == 12


def test_rows_are_computed_once(spark, store):
    """Checks, buckets, joins and snapshots read what was kept, not the plan of the rows."""
    seen = spark.sparkContext.accumulator(0)

    def mark(x):
        seen.add(1)
        return x

    marked = F.udf(mark, "long").asNondeterministic()
    change = store.begin()
    for low in (0, 50):  # new rows, then half of them again
        seen.value = 0
        change.upsert("t", spark.range(low, low + 100).select(marked("id").alias("k"), F.lit(low).alias("v")), ["k"])
        assert seen.value == 100
    change.upsert("t", spark.createDataFrame([(3, 7)], "k int, v int"), ["k"])  # a narrower type of key
    change.commit()
    assert store.read("t").agg(F.count("*"), F.count_distinct("k"), F.sum("v")).first() == (150, 150, 5007)
    lifecycle_store.open_cases(store, spark.range(20).select(F.concat(F.lit("c"), "id").alias("case_id")))
    actions = act(spark, *[(f"c{k}", "comment", None, "ann", None, "hm") for k in range(9)])
    seen.value = 0
    lifecycle_store.apply_actions(store, actions.withColumn("comment", F.concat("comment", marked(F.length("comment").cast("long")).cast("string"))))
    assert seen.value == 9 and store.read("case_events").filter("comment = 'hm2'").count() == 9
