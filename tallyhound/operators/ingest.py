"""Silver tables to raw records to staged tables, in stored versions, counted while they are written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.operators.staging import LOAD_ORDER, TABLES, duplicates, orphans, raw_records, transform_all
from tallyhound.sources.versioned import Store, Transaction

AUDIT = "run_id string, stage string, table_name string, row_count long, missing_keys long, status string, details string, recorded_at timestamp_ntz"


def _audit(change: Transaction, run_id: str, stage: str, details: dict) -> DataFrame:
    """One row a table, from the counts of the writes themselves."""
    spark = change.store.spark
    text = ", ".join(f"{k}={v}" for k, v in sorted(details.items()))
    rows = [(run_id, stage, t, c["rows"], c["missing_keys"], "completed", text) for t, c in change.counts.items()]
    audit = spark.createDataFrame(rows, AUDIT.rpartition(", ")[0]).withColumn("recorded_at", F.localtimestamp())
    change.append("audit_events", audit)
    return audit


def ingest_raw(store: Store, silver: dict[str, DataFrame], system: str = "silver", files: dict[str, str] | None = None, run_id: str = "run") -> int:
    """Appends all silver tables as raw records in one version, with an audit row each; every core table must be there. The version.

    Raw ids grow with each ingest and are unique in a table; rows without their key are kept, and counted."""
    absent = [t for t in LOAD_ORDER if t not in silver]
    if absent:
        raise FileNotFoundError(f"silver tables missing: {', '.join(absent)}")
    change = store.begin()
    base = (change.base["version"] + 1) << 40
    for t in LOAD_ORDER:
        key = TABLES[t][0]
        records = raw_records(silver[t], system, (files or {}).get(t, f"{t}.parquet"), t)
        numbered = records.withColumns({"raw_record_id": F.lit(base) + F.monotonically_increasing_id(), "ingested_at": F.localtimestamp()})
        change.append(f"raw_{t}", numbered, {"missing_keys": F.count_if(F.get_json_object("payload", f"$.{key}").isNull())})
    _audit(change, run_id, "ingest", {"source_system": system})
    return change.commit(f"ingest {run_id}")


def read_raw(store: Store, table: str, limit: int | None = None, version: int | None = None) -> DataFrame:
    """One raw table in the order of its ids. Only raw tables can be read."""
    if table not in LOAD_ORDER:
        raise ValueError(f"{table} is no raw table")
    if limit is not None and limit < 0:
        raise ValueError("a limit can't be negative")
    rows = store.read(f"raw_{table}", version)
    return rows if limit is None else rows.orderBy("raw_record_id").limit(limit)


def expanded(raw: DataFrame, table: str) -> DataFrame:
    """The payload's fields as text, with the columns that say which record is the newest."""
    schema = ", ".join(f"`{c}` string" for c in TABLES[table][1])
    return raw.select(F.from_json("payload", schema).alias("p"), "ingested_at", "raw_record_id").select("p.*", "ingested_at", "raw_record_id")


def problems(staged: dict[str, DataFrame]) -> DataFrame:
    """check_name, violations of staged tables: keys that are null or repeat, accounts without their customer, senders without their account."""
    checks = {}
    for t, frame in staged.items():
        key = TABLES[t][0]
        checks[f"null_{t}_key"] = frame.filter(F.col(key).isNull())
        checks[f"duplicate_{t}"] = duplicates(frame, [key])
    if {"accounts", "customers"} <= set(staged):
        checks["orphan_account_customers"] = orphans(staged["accounts"], "customer_id", staged["customers"], "customer_id")
    if {"transactions", "accounts"} <= set(staged):
        checks["orphan_senders"] = orphans(staged["transactions"], "sender_account_id", staged["accounts"], "account_id")
    return reduce(DataFrame.unionByName, [f.agg(F.lit(k).alias("check_name"), F.count("*").alias("violations")) for k, f in checks.items()])


def stage_raw(store: Store, limit: int | None = None, validate: bool = True, run_id: str = "run") -> int:
    """Transforms the stored raw tables and upserts them into the staged ones in one version, with an audit row each. The version.
    ``validate``: any violation is an error, and then nothing is stored."""
    change = store.begin()
    raw = {t: expanded(read_raw(store, t, limit, change.base["version"]), t) for t in LOAD_ORDER}
    staged = transform_all(raw)
    if validate:
        bad = problems(staged).filter("violations > 0").orderBy("check_name").first()
        if bad:
            raise ValueError(f"{bad.check_name}: {bad.violations} violations")
    for t, frame in staged.items():
        change.upsert(f"stg_{t}", frame, [TABLES[t][0]], {"missing_keys": F.count_if(F.col(TABLES[t][0]).isNull())})
    _audit(change, run_id, "staging", {"limit": limit, "validate": validate})
    return change.commit(f"stage {run_id}")
