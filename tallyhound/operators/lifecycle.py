"""Case lifecycle as an append-only event table, labels, and supervised datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.functions.analytic import latest_per_key
from tallyhound.functions.ids import iso

#: Statuses, the transitions allowed between them, and what they say as labels.
TERMINAL = ("Closed false positive", "Closed suspicious", "Archived")
TRANSITIONS = {
    "New": ("In review", "Escalated", "Information requested", "Closed false positive", "Closed suspicious", "Archived"),
    "In review": ("Escalated", "Information requested", "Closed false positive", "Closed suspicious", "Archived"),
    "Escalated": ("In review", "Information requested", "Closed false positive", "Closed suspicious", "Archived"),
    "Information requested": ("In review", "Escalated", "Closed false positive", "Closed suspicious", "Archived"),
    "Closed false positive": ("Archived",),
    "Closed suspicious": ("Archived",),
    "Archived": (),
}
LABELS = {"Closed suspicious": 1, "Escalated": 1, "Closed false positive": 0}
ACTION_FIELDS = ("action_timestamp", "action_type", "analyst_id", "assigned_to", "case_id", "comment", "decision_reason", "from_status", "metadata", "queue", "to_status")


def allowed(from_status: Column, to_status: Column) -> Column:
    pairs = [f"{a}>{b}" for a, bs in TRANSITIONS.items() for b in bs]
    return F.concat(from_status, F.lit(">"), to_status).isin(pairs)


def check_transition(from_status: str, to_status: str) -> None:
    if to_status not in TRANSITIONS.get(from_status, ()):
        raise ValueError(f"a case can't go from {from_status} to {to_status}")


def action_id(events: DataFrame) -> DataFrame:
    """Deterministic ids: SHA-256 of who did what to which case, when, as key-sorted JSON. Texts are hashed as UTF-8."""

    def quoted(c: str) -> Column:
        if c not in events.columns:
            return F.lit("{}" if c == "metadata" else "null")
        value = iso(F.col(c)) if c == "action_timestamp" else F.col(c).cast("string")
        if c == "metadata":
            return F.coalesce(value, F.lit("{}"))
        return F.coalesce(F.regexp_extract(F.to_json(F.array(value)), r"^\[(\".*\")\]$", 1), F.lit("null"))

    fields = [F.concat(F.lit(f'"{c}": '), F.when(F.col(c).isNull(), F.lit("{}" if c == "metadata" else "null")).otherwise(quoted(c)) if c in events.columns else quoted(c)) for c in ACTION_FIELDS]
    payload = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    return events.withColumn("action_id", F.concat(F.lit("CASE_ACTION_"), F.upper(F.substring(F.sha2(payload, 256), 1, 16))))


def invalid_actions(events: DataFrame) -> DataFrame:
    """Actions that break a rule: a transition that isn't allowed, or a closure without reason and comment."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    change = F.col("action_type") == "status_change"
    bad = change & (~F.coalesce(allowed(F.col("from_status"), F.col("to_status")), F.lit(False)) | (F.col("to_status").startswith("Closed") & (blank("decision_reason") | blank("comment"))))
    return events.filter(bad | blank("case_id"))


def append_action(
    events: DataFrame, case: str, kind: str, to_status: str | None = None, analyst: str = "local_analyst", reason: str | None = None, comment: str | None = None, at: str | None = None,
    assigned_to: str | None = None, queue: str | None = None,
) -> DataFrame:
    """The event table with one more action, from the case's present status: a status change, an assignment (to someone or
    a queue), or a comment."""
    if not case.strip() or not analyst.strip():
        raise ValueError("an action has a case and an analyst")
    now = current_state(events).filter(F.col("case_id") == case).select("status").first()
    status = now.status if now else "New"
    if kind == "status_change":
        check_transition(status, to_status or "")
        if (to_status or "").startswith("Closed") and not ((reason or "").strip() and (comment or "").strip()):
            raise ValueError("a closure needs a reason and a comment")
    if kind == "assign" and not ((assigned_to or "").strip() or (queue or "").strip()):
        raise ValueError("an assignment names someone or a queue")
    if kind == "comment" and not (comment or "").strip():
        raise ValueError("a comment has a text")
    row = events.sparkSession.createDataFrame([(case, kind, status, to_status, analyst, reason, comment, assigned_to, queue, at)], "case_id string, action_type string, from_status string, to_status string, analyst_id string, decision_reason string, comment string, assigned_to string, queue string, at string")
    row = action_id(row.withColumn("action_timestamp", F.coalesce(F.col("at").cast("timestamp_ntz"), F.localtimestamp())).drop("at"))
    return events.unionByName(row, allowMissingColumns=True)


def assign(events: DataFrame, case: str, assigned_to: str | None = None, queue: str | None = None, analyst: str = "local_analyst", comment: str | None = None, at: str | None = None) -> DataFrame:
    return append_action(events, case, "assign", analyst=analyst, comment=comment, at=at, assigned_to=assigned_to, queue=queue)


def assignments(events: DataFrame) -> DataFrame:
    """The newest assignment of each case: case_id, assigned_to, queue, assigned_by, assigned_at."""
    made = latest_per_key(events.filter("action_type = 'assign'"), ["case_id"], [F.desc("action_timestamp"), F.desc("action_id")])
    queue = F.col("queue") if "queue" in events.columns else F.lit(None).cast("string")
    return made.select("case_id", "assigned_to", queue.alias("queue"), F.col("analyst_id").alias("assigned_by"), F.col("action_timestamp").alias("assigned_at"))


def current_state(events: DataFrame) -> DataFrame:
    """Status and assignee of each case: one fold over its events."""
    order = F.struct("action_timestamp", "action_id")
    return events.groupBy("case_id").agg(
        F.coalesce(F.max_by("to_status", F.when(F.col("to_status").isNotNull(), order)), F.lit("New")).alias("status"), F.max_by("assigned_to", F.when(F.col("assigned_to").isNotNull(), order)).alias("assigned_to") if "assigned_to" in events.columns else F.lit(None).cast("string").alias("assigned_to"),
        F.max("action_timestamp").alias("updated_at"), F.count("*").alias("events"))


def timeline(events: DataFrame, case: str | None = None) -> DataFrame:
    chosen = events.filter(F.col("case_id") == case) if case else events
    return chosen.orderBy("case_id", "action_timestamp", "action_id")


def lifecycle_summary(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("events"), F.count_distinct("case_id").alias("cases"), F.count_distinct("analyst_id").alias("analysts"), F.count(F.when(F.col("to_status").startswith("Closed"), 1)).alias("closures"))


def status_label(status: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[status]


def latest_decisions(events: DataFrame) -> DataFrame:
    """The newest event of each case whose status has a label."""
    eligible = events.filter(status_label(F.col("to_status")).isNotNull())
    return latest_per_key(eligible, ["case_id"], [F.desc("action_timestamp"), F.desc("action_id")])


def label_violations(cases: DataFrame, events: DataFrame) -> DataFrame:
    """case_id, problem: decisions that must not become labels."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    d = latest_decisions(events).select("case_id", "action_timestamp", "decision_reason", "comment")
    made = cases.select("case_id", F.col("created_at") if "created_at" in cases.columns else F.lit(None).cast("timestamp_ntz").alias("created_at")).dropDuplicates(["case_id"])
    d = d.join(made, "case_id", "left")
    problems = F.array_compact(F.array(
        F.when(blank("decision_reason"), "a closure label needs a reason"), F.when(blank("comment"), "a closure label needs a comment"),
        F.when(F.col("action_timestamp").isNull(), "a label needs a time"), F.when(F.col("action_timestamp") < F.col("created_at"), "the label is before the case"),
    ))
    return d.select("case_id", F.explode(problems).alias("problem"))


def case_labels(cases: DataFrame, events: DataFrame, enforce: bool = False) -> DataFrame:
    """Cases with their newest decision as label. ``enforce``: a decision that must not become one is an error."""
    if enforce:
        bad = label_violations(cases, events).first()
        if bad:
            raise ValueError(f"{bad.case_id}: {bad.problem}")
    d = latest_decisions(events).select("case_id", "to_status", "action_timestamp", "analyst_id")
    out = cases.select("case_id", "primary_account_id").join(d, "case_id")
    return out.withColumns({"label": status_label(F.col("to_status")), "label_status": F.col("to_status"), "label_timestamp": F.col("action_timestamp")}).drop("to_status", "action_timestamp")


def account_labels(labels: DataFrame, entities: DataFrame, newest: bool = False) -> DataFrame:
    """An account's worst label over its cases, or its newest."""
    links = labels.select("case_id", F.col("primary_account_id").alias("account_id")).union(entities.filter("entity_type = 'account'").select("case_id", F.col("entity_id").alias("account_id"))).distinct()
    joined = links.join(labels.select("case_id", "label", "label_timestamp"), "case_id")
    label = F.max_by("label", F.struct("label_timestamp", "case_id")) if newest else F.max("label")
    return joined.groupBy("account_id").agg(label.alias("label"), F.max("label_timestamp").alias("label_timestamp"), F.count("*").alias("case_count"))


def supervised_dataset(labels: DataFrame, key: str, *features: tuple[DataFrame, str | None], enforce: bool = False) -> DataFrame:
    """Labels with the latest row of each feature frame; given frames as (frame, its time column or None). ``enforce``:
    features newer than their label are an error."""
    out = labels
    for frame, at in features:
        order = [F.desc_nulls_last(at)] if at else [F.asc(c) for c in frame.columns if c != key][:1]
        one = latest_per_key(frame, [key], order)
        out = out.join(one.drop(*[c for c in one.columns if c != key and c in out.columns]), key, "left")
        if enforce and at and at in out.columns and not leaks(out, at).isEmpty():
            raise ValueError(f"{at} is after the label's time")
    return out


def leaks(dataset: DataFrame, feature_at: str, label_at: str = "label_timestamp") -> DataFrame:
    """Rows whose features are newer than their label."""
    return dataset.filter(F.col(feature_at) > F.col(label_at))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
