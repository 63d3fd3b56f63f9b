"""Streamed rules against the batch rules: ties, late rows, restarts, rows that come too late."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from tallyhound.operators import rules
from tallyhound.plans import stream_queries
from tallyhound.streaming import stateful
from tallyhound.streaming.rules import transaction_stream

SCHEMA = "transaction_id string, sender_account_id string, receiver_account_id string, counterparty_id string, transaction_timestamp timestamp_ntz, amount decimal(18,2), transaction_type string, extra int"
START = dt.datetime(2024, 1, 1)


def bank(spark, seed):
    """Few accounts, whole hours and few amounts, so that times, counts and sums tie; some rows no rule takes."""
    r = random.Random(seed)
    rows = []
    for k in range(600):
        receiver = r.choice([*"ABCDEF", None])
        at = START + dt.timedelta(hours=r.choice([r.randrange(100), 2000 + r.randrange(300), 6000 + r.randrange(100)]))
        rows.append((f"T{k}", r.choice([*"ABCDEFGH", None]), receiver, r.choice(["X", None]), at, r.choice([Decimal(9500), Decimal(9600), Decimal(50), Decimal(20000), None]), r.choice(["wire", "transfer", "other"]), k))
    return spark.createDataFrame(rows, SCHEMA)


def same(got, want):
    take = lambda f: sorted(map(repr, f.select(*sorted(want.columns)).collect()))
    plain = lambda f: f.select(*[F.col(c).cast("string") if not t.startswith("array") else c for c, t in f.dtypes])
    assert take(plain(got)) == take(plain(want))


def test_structuring(spark):
    c = rules.Structuring(min_count=2, window_hours=6)
    t = bank(spark, 1)
    got = stream_queries.replayed(t, lambda s, late: stateful.structuring_stream(s, c, late), c.window_hours * rules.HOUR)
    want = rules.detect_structuring(t, c)
    assert want.count() > 2
    same(stateful.structuring_detections(got), want)


def test_dormant(spark):
    c = rules.DormantReactivation(dormant_days=10, window_days=2, min_amount=9000.0, min_total=9000.0)
    t = bank(spark, 3)
    got = stream_queries.replayed(t, lambda s, late: stateful.dormant_stream(s, c, late), c.window_days * rules.DAY)
    want = rules.detect_dormant_reactivation(t, c)
    assert want.count() > 2
    same(stateful.dormant_detections(got, c), want)


def test_empty(spark):
    c = rules.Structuring()
    got = stream_queries.replayed(spark.createDataFrame([], SCHEMA), lambda s, late: stateful.structuring_stream(s, c, late), rules.DAY)
    assert stateful.structuring_detections(got).count() == 0


def test_too_late_and_not_yet(spark, tmp_path):
    """A row older than the watermark changes nothing; a window that is not over is not judged; time moves by any row."""
    c = rules.Structuring(min_count=2, window_hours=2)

    def come(*rows):
        made = [(f"T{i}", "A", "B", None, START + dt.timedelta(hours=h), Decimal(9500), kind, 0) for i, h, kind in rows]
        spark.createDataFrame(made, SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        stream = transaction_stream(spark, str(tmp_path / "in"), SCHEMA)
        stateful.start(stateful.structuring_stream(stream, c, "3 hours"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return [(r.place, r.evidence_ids) for r in spark.read.schema(stateful.FOUND).parquet(str(tmp_path / "out")).orderBy("place").collect()]

    assert come((0, 10, "wire"), (1, 11, "wire")) == []
    assert come((2, 10.5, "wire"), (3, 14.9, "other")) == []
    first = (1, ["T0", "T2", "T1"])
    assert come((4, 20, "other")) == [first]
    assert come((5, 11.5, "wire"), (6, 12, "wire")) == [first]
    assert come((7, 30, "wire"), (8, 31, "wire"), (9, 31, "wire"), (10, 32, "wire")) == [first]
    assert come((11, 60, "other")) == [first, (2, ["T7", "T8", "T9", "T10"])]


def test_many_accounts_few_states(spark, tmp_path):
    """A call into Python is made for each group of accounts, not for each account."""
    c, accounts = rules.Structuring(min_count=2, window_hours=2), 2 * stateful.GROUPS
    made = [(f"T{a}_{k}", f"A{a}", "B", None, START + dt.timedelta(hours=k), Decimal(9500), "wire", 0) for a in range(accounts) for k in range(2 + a % 2)]
    t = spark.createDataFrame([*made, ("END", "A0", "B", None, START + dt.timedelta(days=9), Decimal(1), "end", 0)], SCHEMA)
    t.write.parquet(str(tmp_path / "in"))
    stream = transaction_stream(spark, str(tmp_path / "in"), SCHEMA)
    run = stateful.start(stateful.structuring_stream(stream, c, "3 hours"), str(tmp_path / "out"), str(tmp_path / "state"))
    run.awaitTermination()
    assert 0 < run.lastProgress["stateOperators"][0]["numRowsTotal"] <= stateful.GROUPS
    found = stateful.newest(spark.read.schema(stateful.FOUND).parquet(str(tmp_path / "out")))
    assert found.count() == accounts
    same(stateful.structuring_detections(found), rules.detect_structuring(t, c))
