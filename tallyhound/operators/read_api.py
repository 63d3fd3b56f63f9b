"""Read side: filters, ordered and limited queues, counts and bundles."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.functions.analytic import latest_per_key
from tallyhound.functions.quantiles import exact_quantiles


def check_limit(limit: int | None) -> int | None:
    if limit is not None and limit < 0:
        raise ValueError("a limit is not negative")
    return limit


def read(frame: DataFrame, equal: dict | None = None, isin: dict | None = None, order: list[Column] | None = None, limit: int | None = None, latest_on: str | None = None, since: tuple[str, int] | None = None) -> DataFrame:
    """Optional equality and list filters, newest partition only, look-back days, order, limit. Filters reach the
    scan; the newest value is a one-row broadcast join."""
    for column, value in (equal or {}).items():
        if value is not None:
            frame = frame.filter(F.col(column) == value)
    for column, values in (isin or {}).items():
        chosen = [v for v in values or [] if v is not None and str(v).strip()]
        if chosen:
            frame = frame.filter(F.col(column).isin(chosen))
    if since and since[1] is not None:
        frame = frame.filter(F.col(since[0]) >= F.current_timestamp() - F.make_dt_interval(days=F.lit(since[1])))
    if latest_on:
        frame = frame.join(F.broadcast(frame.agg(F.max(latest_on).alias(latest_on))), latest_on, "left_semi")
    if order:
        frame = frame.orderBy(*order)
    return frame if check_limit(limit) is None else frame.limit(limit)


def contains_any(frame: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows where any column holds the text, in any case; the text is taken literally."""
    if not needle.strip():
        return frame
    return frame.filter(reduce(or_, [F.coalesce(F.lower(F.col(c).cast("string")).contains(needle.strip().lower()), F.lit(False)) for c in columns]))


def alert_queue(alerts: DataFrame, severities: list | None = None, typologies: list | None = None, account: str | None = None, limit: int | None = None) -> DataFrame:
    chosen = read(alerts, isin={"severity": severities, "typology": typologies})
    chosen = contains_any(chosen, account, ["account_id"]) if account else chosen
    return read(chosen, order=[F.desc_nulls_last("risk_score_rule"), F.asc("alert_id")], limit=limit)


def case_queue(cases: DataFrame, scores: DataFrame, statuses: list | None = None, bands: list | None = None, limit: int | None = None) -> DataFrame:
    """Cases with their latest score; filters come after the join, so a band filter drops unscored cases."""
    both = cases.join(scores, "case_id", "left")
    return read(both, isin={"status": statuses, "risk_band": bands}, order=[F.desc_nulls_last("case_risk_score"), F.desc_nulls_last("priority_score"), F.asc("case_id")], limit=limit)


def top_ranked(scores: DataFrame, score: str, key: str, k: int = 25) -> DataFrame:
    return scores.orderBy(F.desc_nulls_last(score), F.asc(key)).limit(check_limit(k))


def value_counts(frame: DataFrame, column: str) -> DataFrame:
    return frame.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy("value")


def filter_options(frame: DataFrame, columns: list[str]) -> DataFrame:
    """column, value: distinct trimmed values, from one scan."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.col(c).cast("string")).alias("value")) for c in columns])).alias("p")
    return frame.select(pairs).select("p.*").filter("value <> ''").distinct()


def overview(**tables: DataFrame) -> DataFrame:
    """table_name, rows."""
    return reduce(DataFrame.unionByName, [f.agg(F.lit(n).alias("table_name"), F.count("*").alias("rows")) for n, f in tables.items()])


def score_distribution(scores: DataFrame, score: str, band: str = "risk_band") -> DataFrame:
    bands = [F.count(F.when(F.col(band) == b, 1)).alias(b) for b in ("low", "medium", "high", "critical")]
    s = F.col(score)
    middle = (exact_quantiles(scores, {"s": s}, [0.5])["s"] or [None])[0]
    return scores.agg(F.count("*").alias("n"), F.min(s).alias("least"), F.max(s).alias("most"), F.avg(s).alias("mean"), F.lit(middle).cast("double").alias("median"), F.stddev_pop(s).alias("deviation"), *bands)


def case_queue_metrics(cases: DataFrame) -> DataFrame:
    """Open, critical and high-risk cases, in one row."""
    status, band = F.lower("status"), F.lower("risk_band")
    still_open = ~F.coalesce(status.startswith("closed") | (status == "archived"), F.lit(True))
    return cases.agg(F.count("*").alias("case_count"), F.count_if(still_open).alias("open_case_count"), F.count_if(band == "critical").alias("critical_case_count"), F.count_if(band.isin("high", "critical")).alias("high_risk_case_count"))


def alert_queue_metrics(alerts: DataFrame) -> DataFrame:
    severity = F.lower("severity")
    return alerts.agg(F.count("*").alias("alert_count"), F.count_if(severity == "critical").alias("critical_alert_count"), F.count_if(severity.isin("high", "critical")).alias("high_alert_count"))


def distributions(frame: DataFrame, columns: list[str], lower: bool = True) -> DataFrame:
    """column, value, n for several columns, from one scan."""
    text = lambda c: F.lower(F.col(c).cast("string")) if lower else F.col(c).cast("string")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("value")) for c in columns])).alias("p")
    return frame.select(pairs).select("p.*").filter("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))


def mart_summary(frame: DataFrame, at: str, key: str = "account_id", versions: tuple[str, ...] = (), bands: str | None = None) -> DataFrame:
    """row_count, distinct keys, newest time, the version columns of the newest row, and how many rows each risk band of the column
    ``bands`` has: graph features, anomaly scores and account scores alike."""
    newest = [F.max_by(F.col(v).cast("string"), F.struct(at, *versions)).alias(f"latest_{v}") for v in versions]
    banded = [F.count_if(F.lower(bands) == b).alias(f"{b}_count") for b in ("low", "medium", "high", "critical")] if bands else []
    return frame.agg(F.count("*").alias("row_count"), F.count_distinct(key).alias("unique_account_count"), F.max(at).alias(f"max_{at}"), *newest, *banded)


def newest_partition(frame: DataFrame, *keys: str) -> DataFrame:
    """The rows of the newest value of ``keys`` taken together, such as date, time and version of a run; nulls come first."""
    last = F.broadcast(frame.agg(F.max(F.struct(*keys)).alias("_last")))  # one row
    return frame.crossJoin(last).filter(F.struct(*keys).eqNullSafe(F.col("_last"))).drop("_last")


def evidence_summary(packs: DataFrame, explanations: DataFrame) -> DataFrame:
    """Packs, explanations, and the cases that have either."""
    both = packs.select("case_id", F.lit(1).alias("p"), F.lit(0).alias("e")).unionByName(explanations.select("case_id", F.lit(0).alias("p"), F.lit(1).alias("e")))
    return both.agg(F.sum("p").alias("evidence_pack_count"), F.sum("e").alias("explanation_count"), F.count_distinct("case_id").alias("unique_case_count"))


def audit_summary(events: DataFrame, at: str = "event_timestamp") -> DataFrame:
    """event_count and the newest event; ``distributions`` gives the counts by component, type and status."""
    return events.agg(F.count("*").alias("event_count"), F.max(at).alias("latest_event_timestamp"))


def audit_search(events: DataFrame, needle: str, columns: tuple[str, ...] = ("event_type", "component", "action", "entity_type", "entity_id", "details")) -> DataFrame:
    """Events that hold a text in any of the columns there are, JSON details included."""
    found = [F.to_json(c) if t.startswith(("struct", "map", "array")) else F.col(c) for c, t in events.dtypes if c in columns]
    return contains_any(events.withColumns({f"_{k}": x for k, x in enumerate(found)}), needle, [f"_{k}" for k in range(len(found))]).select(events.columns)


def cycle_summary(cycles: DataFrame) -> DataFrame:
    """One row over circular flows: cycles, accounts, lengths, spans, evidence and amounts."""
    numbers = [f(c).cast("double").alias(f"{n}_{c}") for c in ("cycle_length", "time_span_hours") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    totals = cycles.agg(F.count("*").alias("cycle_count"), F.count_distinct("primary_account_id").alias("unique_primary_account_count"), *numbers, F.coalesce(F.sum(F.size("evidence_ids")), F.lit(0)).cast("long").alias("total_evidence_transaction_count"), F.avg("total_amount").cast("double").alias("mean_total_amount"), F.max("total_amount").cast("double").alias("max_total_amount"))
    accounts = cycles.select(F.explode("cycle_accounts").alias("a")).agg(F.count_distinct("a").alias("unique_account_count"))
    return totals.crossJoin(accounts)  # one row each


def newest_of(frame: DataFrame, key: str, *order: str) -> DataFrame:
    return latest_per_key(frame, [key], [F.desc_nulls_last(c) for c in order])


def account_header(accounts: DataFrame, customers: DataFrame, risks: DataFrame, anomalies: DataFrame, graph: DataFrame, account: str | None = None) -> DataFrame:
    """An account (or all) with its customer and its newest risk score, anomaly score and community."""
    if account is not None and not account.strip():
        raise ValueError("an account has an id")
    a = accounts if account is None else accounts.filter(F.col("account_id") == account.strip())
    c = customers.select("customer_id", *(x for x in ("customer_name", "customer_segment", "customer_risk_rating") if x in customers.columns and x not in a.columns), F.col("jurisdiction").alias("customer_country_code"))
    r = newest_of(risks, "account_id", "score_date", "scored_at").select("account_id", "account_risk_score", F.col("risk_band").alias("account_risk_band"))
    n = newest_of(anomalies, "account_id", "score_date", "scored_at").select("account_id", "anomaly_score", F.col("risk_band").alias("anomaly_risk_band"))
    g = newest_of(graph, "account_id", "feature_date", "computed_at").select("account_id", "community_id", "community_size")
    return a.join(c, "customer_id", "left").join(r, "account_id", "left").join(n, "account_id", "left").join(g, "account_id", "left")


def account_bundle(account: str, header: DataFrame, transactions: DataFrame, alerts: DataFrame, cases: DataFrame | None, entities: DataFrame | None, days: int | None = None, limit: int | None = None) -> dict[str, DataFrame]:
    """Header, movements (of the last days), alerts, cases (where they are given) and other sides of one account."""
    mine = transactions.filter((F.col("sender_account_id") == account) | (F.col("receiver_account_id") == account))
    return {
        "header": header.filter(F.col("account_id") == account), "transactions": read(mine, since=("transaction_timestamp", days) if days is not None else None, order=[F.desc("transaction_timestamp"), F.asc("transaction_id")], limit=limit),
        "alerts": read(alerts, {"account_id": account}, order=[F.desc_nulls_last("risk_score_rule"), F.asc("alert_id")], limit=limit), "counterparties": counterparty_rollup(transactions, account),
    } | ({} if cases is None else {"cases": cases.join(linked_cases(cases, entities, account), "case_id", "left_semi")})


def case_evidence_bundle(case_id: str, packs: DataFrame, explanations: DataFrame) -> dict[str, DataFrame]:
    """Evidence packs and explanations of one case, newest first."""
    if not case_id or not case_id.strip():
        raise ValueError("a case has an id")
    mine = lambda f, version: read(f, {"case_id": case_id}, order=[F.desc_nulls_last(c) if c == "created_at" else F.asc(c) for c in ("created_at", version) if c in f.columns] or None)
    return {"evidence_packs": mine(packs, "evidence_version"), "explanations": mine(explanations, "explanation_version")}


def seed_accounts(accounts: DataFrame, risks: DataFrame, graph: DataFrame, cases: DataFrame, entities: DataFrame, case_id: str | None = None, account: str | None = None, community: str | None = None, band: str | None = None, limit: int | None = None) -> DataFrame:
    """Where a look at the graph starts: the accounts of a case (its primary, and those it names; with ``account``, that one
    too), one account, a community or a risk band; the riskiest first."""
    r = newest_of(risks, "account_id", "score_date", "scored_at").select("account_id", "account_risk_score", "risk_band")
    g = newest_of(graph, "account_id", "feature_date", "computed_at").select("account_id", "community_id", "community_size", "pagerank_score", "degree", "high_risk_alert_count")
    out = accounts.select("account_id", "customer_id").join(r, "account_id", "left").join(g, "account_id", "left")
    if case_id:
        named = entities.filter((F.col("case_id") == case_id) & F.col("entity_type").isin("account", "primary_account", "related_account")).select(F.col("entity_id").alias("account_id"))
        some = cases.filter(F.col("case_id") == case_id).select(F.col("primary_account_id").alias("account_id")).union(named)
        if account:
            some = some.union(some.sparkSession.range(1).select(F.lit(account).alias("account_id")))
        out = out.join(some.distinct(), "account_id", "left_semi")
    elif account:
        out = out.filter(F.col("account_id") == account)
    if community:
        out = out.filter(F.col("community_id").cast("string") == community)
    return read(out, {"risk_band": band}, order=[F.desc_nulls_last("account_risk_score"), F.asc("account_id")], limit=limit)


def graph_context(seeds: DataFrame, transactions: DataFrame, alerts: DataFrame, cases: DataFrame, most_edges: int | None = 500) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges around seed accounts: their transactions, those at the other ends, their alerts and cases."""
    s = seeds.select("account_id")
    out = transactions.join(s, transactions["sender_account_id"] == s["account_id"], "left_semi")
    edges = read(out.select(F.col("sender_account_id").alias("source_id"), F.coalesce("receiver_account_id", "counterparty_id").alias("target_id"), "transaction_id", "amount", "transaction_timestamp"), order=[F.desc("transaction_timestamp"), F.asc("transaction_id")], limit=most_edges)
    text = F.lit(None).cast("string")
    node = lambda f, kind, key, score, band=None, community=None: f.select(F.col(key).alias("node_id"), F.lit(kind).alias("node_type"), F.col(key).alias("label"), score.cast("double").alias("risk_score"), (band if band is not None else text).alias("risk_band"), (community if community is not None else text).alias("community_id"))
    others = edges.select(F.col("target_id").alias("account_id")).filter("account_id IS NOT NULL").distinct()
    ends = others.join(s, "account_id", "left_anti")
    parts = [
        node(seeds, "account", "account_id", F.col("account_risk_score"), F.col("risk_band"), F.col("community_id").cast("string")), node(ends, "counterparty", "account_id", F.lit(None)),
        node(alerts.join(s, "account_id", "left_semi"), "alert", "alert_id", F.col("risk_score_rule")), node(cases.join(s, cases["primary_account_id"] == s["account_id"], "left_semi"), "case", "case_id", F.col("priority_score")),
    ]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["node_id", "node_type"]), edges


def graph_view_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    kinds = [F.count_if(F.col("node_type") == k).alias(f"{k}_count") for k in ("account", "transaction", "counterparty", "alert", "case")]
    n = nodes.agg(F.count("*").alias("node_count"), *kinds, F.count_distinct("community_id").alias("community_count"), F.max("risk_score").alias("max_risk_score"))
    return n.crossJoin(edges.agg(F.count("*").alias("edge_count")))  # one row each


def account_summary(transactions: DataFrame, account: str) -> DataFrame:
    """Counts and value of one account's movements; the account is given, not guessed."""
    out, into = F.col("sender_account_id") == account, F.coalesce(F.col("receiver_account_id") == account, F.lit(False))
    t = transactions.filter(out | into)
    zero = F.lit(0).cast("decimal(28,2)")
    return t.agg(F.count("*").alias("transaction_count"), F.coalesce(F.sum(F.when(out, F.col("amount"))), zero).alias("total_sent"), F.coalesce(F.sum(F.when(into, F.col("amount"))), zero).alias("total_received"), F.max("amount").alias("max_amount"), F.count_distinct("counterparty_id").alias("counterparty_count"))


def counterparty_rollup(transactions: DataFrame, account: str, corrected: bool = True) -> DataFrame:
    """The other side of one account's movements. Uncorrected, an inbound row names the account itself."""
    t = transactions.filter((F.col("sender_account_id") == account) | (F.col("receiver_account_id") == account))
    other = F.coalesce("receiver_account_id", "counterparty_id")
    if corrected:
        other = F.when(F.col("sender_account_id") == account, other).otherwise(F.col("sender_account_id"))
    return t.groupBy(other.alias("other")).agg(F.count("*").alias("transaction_count"), F.sum("amount").alias("total_amount"), F.max("transaction_timestamp").alias("last_at"))


def linked_cases(cases: DataFrame, entities: DataFrame, account: str) -> DataFrame:
    """Cases whose primary account it is, or that name it; each once."""
    named = entities.filter((F.col("entity_type") == "account") & (F.col("entity_id") == account)).select("case_id")
    return cases.filter(F.col("primary_account_id") == account).select("case_id").union(named).distinct()


def case_bundle(case_id: str, cases: DataFrame, alerts: DataFrame, links: DataFrame, entities: DataFrame, scores: DataFrame) -> dict[str, DataFrame]:
    mine = links.filter(F.col("case_id") == case_id)
    return {"case": cases.filter(F.col("case_id") == case_id), "alerts": alerts.join(mine, "alert_id", "left_semi"), "entities": entities.filter(F.col("case_id") == case_id), "scores": scores.filter(F.col("case_id") == case_id)}


def latest_scores(scores: DataFrame, key: str, at: str, score: str) -> DataFrame:
    return latest_per_key(scores, [key], [F.desc_nulls_last(at), F.desc_nulls_last(score)])


def versions(scores: DataFrame, version: str, at: str) -> DataFrame:
    return scores.groupBy(version).agg(F.count("*").alias("rows"), F.max(at).alias("latest"))


def node_sizes(nodes: DataFrame, score: str, least: float = 12, most: float = 42) -> DataFrame:
    """Sizes by the score cut to 0 to 100, nulls as 0."""
    if not 0 < least <= most:
        raise ValueError("sizes are positive, the least first")
    cut = F.least(F.greatest(F.coalesce(F.col(score).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(100.0))
    return nodes.withColumn("node_size", least + cut / 100 * (most - least))


def graph_view(nodes: DataFrame, edges: DataFrame, most_nodes: int = 200, most_edges: int = 500) -> tuple[DataFrame, DataFrame]:
    """The highest-scored nodes and the edges between them."""
    kept = nodes.orderBy(F.desc_nulls_last("score"), "id").limit(check_limit(most_nodes))
    inner = edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi")
    return kept, inner.orderBy("src", "dst").limit(check_limit(most_edges))
