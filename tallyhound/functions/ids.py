"""Deterministic identifiers and the texts they are made from."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a wall-clock time."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def iso(ts: Column) -> Column:
    """ISO 8601 with the UTC offset; microseconds only where there are any."""
    ts = ts.cast("timestamp_ntz")
    fraction = F.when(F.pmod(micros(ts), F.lit(1_000_000)) != 0, F.date_format(ts, ".SSSSSS")).otherwise("")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def rule_part(rule_name: str) -> str:
    part = re.sub(r"[^A-Za-z0-9]+", "_", rule_name).strip("_").upper()
    if not part:
        raise ValueError("a rule name holds letters or digits")
    return part


def alert_id(rule_name: str, account: Column, start: Column, evidence: Column) -> Column:
    """AL_<RULE>_ and eight hex digits; the evidence counts in sorted order."""
    part = rule_part(rule_name)
    key = F.concat_ws("|", F.lit(part), F.upper(account), F.coalesce(start, F.lit("")), F.array_join(F.array_sort(evidence), "|"))
    return F.concat(F.lit(f"AL_{part}_"), F.upper(F.substring(F.sha2(key, 256), 1, 8)))


def sequential_id(prefix: str, sequence: Column) -> Column:
    return F.format_string(prefix.strip().upper() + "%06d", sequence)


def cycle_id(accounts: Column, evidence: Column) -> Column:
    key = F.concat(F.array_join(accounts, "|"), F.lit("||"), F.array_join(F.array_sort(evidence), "|"))
    return F.concat(F.lit("CF_"), F.upper(F.substring(F.sha2(key, 256), 1, 8)))


def case_group_id(strategy: Column, key: Column, alert_ids: Column) -> Column:
    payload = F.concat_ws("|", strategy, key, F.array_join(F.array_sort(alert_ids), "|"))
    return F.concat(F.lit("CASE_GROUP_"), F.upper(strategy), F.lit("_"), F.substring(F.sha2(payload, 256), 1, 16))


def case_id(group_id: Column, version: str) -> Column:
    part = re.sub(r"[^a-z0-9]", "_", version.lower()).strip("_").upper() or "CASE"
    return F.concat(F.lit(f"CASE_{part}_"), F.substring(F.sha2(F.concat(F.lit(f"{version}|"), group_id), 256), 1, 16))


def record_hash(payload: Column) -> Column:
    return F.sha2(payload, 256)
