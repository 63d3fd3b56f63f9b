"""Case actions applied to stored tables: events, case snapshots and assignments change in one transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.checkpoints import Scratch
from tallyhound.operators.lifecycle import action_id, invalid_actions
from tallyhound.sources.versioned import Store

EVENTS = (
    "action_id string, case_id string, action_type string, from_status string, to_status string, analyst_id string, decision_reason string, comment string, assigned_to string, queue string, "
    "action_timestamp timestamp_ntz"
)
ASSIGNMENTS = "case_id string, assigned_to string, queue string, assigned_by string, assigned_at timestamp_ntz"
KINDS = ("status_change", "assign", "comment")


def _typed(frame: DataFrame, ddl: str) -> DataFrame:
    pairs = [c.split(" ") for c in ddl.split(", ")]
    return frame.select([(F.col(n) if n in frame.columns else F.lit(None)).cast(t).alias(n) for n, t in pairs])


def open_cases(store: Store, cases: DataFrame) -> int:
    """Stores new cases: case_id and any other columns; status is New where it is missing."""
    status = F.coalesce(F.col("status"), F.lit("New")) if "status" in cases.columns else F.lit("New")
    none = lambda t: F.lit(None).cast(t)
    made = cases.withColumns({"status": status, "assigned_to": none("string"), "queue": none("string"), "updated_at": none("timestamp_ntz")})
    change = store.begin()
    change.upsert("cases", made, ["case_id"])
    return change.commit("open cases")


def with_from_status(actions: DataFrame, cases: DataFrame) -> DataFrame:
    """``actions`` with the status that each finds: that of the last change before it in its case, else the stored one."""
    order = Window.partitionBy("case_id").orderBy("action_timestamp", "_k").rowsBetween(Window.unboundedPreceding, -1)
    stored = cases.select("case_id", F.col("status").alias("_stored"))
    found = actions.join(stored, "case_id", "left").withColumn("_last", F.last("to_status", ignorenulls=True).over(order))
    return found.withColumn("from_status", F.coalesce("_last", "_stored")).drop("_last", "_stored")


def apply_actions(store: Store, actions: DataFrame, note: str = "case actions") -> int:
    """Applies actions (case_id, action_type, to_status, analyst_id, decision_reason, comment, assigned_to, queue,
    action_timestamp) in the order of their times, those of one time in the order of ``action_key`` where there is one. The version.

    An unknown case or kind, a transition that is not allowed, a closure without reason and comment, an assignment to nobody and an empty comment
    are errors, and then nothing is stored. Each case's actions of one call are one group."""
    change = store.begin()
    cases = change.read("cases")
    if cases is None:
        raise ValueError("there are no cases")
    keyed = actions.withColumn("_k", F.col("action_key") if "action_key" in actions.columns else F.lit(""))
    with Scratch() as keep:
        # computed once: checked, appended, and folded into both snapshots
        rows = keep(with_from_status(_typed(keyed, EVENTS + ", _k string").drop("action_id", "from_status"), cases))
        blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
        kind = F.col("action_type")
        wrong = F.col("from_status").isNull() | ~F.coalesce(kind.isin(*KINDS), F.lit(False)) | blank("analyst_id") | F.col("action_timestamp").isNull()
        wrong = wrong | (kind == "assign") & blank("assigned_to") & blank("queue") | (kind == "comment") & blank("comment") | (kind != "status_change") & F.col("to_status").isNotNull()
        bad = rows.filter(wrong).unionByName(invalid_actions(rows)).orderBy("case_id", "action_timestamp").first()
        if bad:
            raise ValueError(f"{bad.case_id}: {bad.action_type} from {bad.from_status} to {bad.to_status} by {bad.analyst_id} can't be applied")
        events = _typed(action_id(rows.drop("_k")), EVENTS)
        at = F.struct("action_timestamp", "_k")
        newest = lambda c, when: F.max_by(c, F.when(when, at))
        assigned = kind == "assign"
        folded = keep(rows.groupBy("case_id").agg(
            newest("to_status", F.col("to_status").isNotNull()).alias("_status"), F.max(F.when(assigned, True)).alias("_assigned"), newest("assigned_to", assigned).alias("_to"), newest("queue", assigned).alias("_queue"),
            newest("analyst_id", assigned).alias("_by"), newest("action_timestamp", assigned).alias("_at"), F.max("action_timestamp").alias("updated_at"),
        ))
        old = cases.select("case_id", "status", "assigned_to", "queue")
        given = F.coalesce("_assigned", F.lit(False))
        snapshot = folded.join(old, "case_id").select(
            "case_id", F.coalesce("_status", "status").alias("status"), F.when(given, F.col("_to")).otherwise(F.col("assigned_to")).alias("assigned_to"), F.when(given, F.col("_queue")).otherwise(F.col("queue")).alias("queue"), "updated_at"
        )
        made = folded.filter("_assigned").select("case_id", F.col("_to").alias("assigned_to"), F.col("_queue").alias("queue"), F.col("_by").alias("assigned_by"), F.col("_at").alias("assigned_at"))
        change.append("case_events", events)
        change.upsert("cases", snapshot, ["case_id"])
        change.upsert("case_assignments", _typed(made, ASSIGNMENTS), ["case_id"])
    return change.commit(note)
