"""The six typology rules: DataFrame of transactions to DataFrame of detections.

Every counted rule is RANGE frames over (account, time): each candidate is an anchor whose window is
[t, t + W], both ends included; counts and values are differences of growing frames. The strongest window of an account is an aggregate (``max_by``), not a sort.
Evidence is gathered only for that window, in a second pass over the same partitioning by account, so no
list is built for the windows that lose. Accounts with too few candidates for any window leave first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.checkpoints import checkpointed
from tallyhound.functions import ids
from tallyhound.functions.normalise import identifier, require_columns

HOUR, DAY = 3_600_000_000, 86_400_000_000
ALERT_COLUMNS = ("alert_id", "account_id", "customer_id", "rule_name", "typology", "severity", "risk_score_rule", "reason_code", "evidence_ids", "detection_window_start", "detection_window_end", "model_run_id", "alert_status")


@dataclass(frozen=True)
class Alerting:
    rule_name: str
    typology: str
    severity: str = "high"
    base_score: float = 80.0
    raised_score: float = 90.0
    template: str | None = None

    def __post_init__(self) -> None:
        if not self.rule_name.strip() or not self.typology.strip():
            raise ValueError("a rule has a name and a typology")
        if self.severity not in ("low", "medium", "high", "critical"):
            raise ValueError(f"unknown severity {self.severity}")
        if not 0 <= self.base_score <= 100 or not 0 <= self.raised_score <= 100:
            raise ValueError("scores are from 0 to 100")


def _positive(**values: float | None) -> None:
    for name, value in values.items():
        if value is not None and value <= 0:
            raise ValueError(f"{name} must be positive")


@dataclass(frozen=True)
class Structuring:
    reporting_threshold: float = 10_000.0
    margin: float = 0.90
    min_count: int = 8
    window_hours: int = 24
    high_count_multiplier: float = 1.5
    types: tuple[str, ...] = ("transfer", "wire")
    include_counterparty_payments: bool = True
    alerting: Alerting = field(default_factory=lambda: Alerting("Structuring", "structuring"))

    def __post_init__(self) -> None:
        _positive(reporting_threshold=self.reporting_threshold, min_count=self.min_count, window_hours=self.window_hours)
        if not 0 < self.margin < 1 or not self.types:
            raise ValueError("the margin is between 0 and 1, and there are types")


@dataclass(frozen=True)
class FanIn:
    min_senders: int = 15
    window_days: int = 7
    min_total: float = 0.0
    multiplier: float = 1.5
    types: tuple[str, ...] = ("transfer", "wire")
    zero_amounts: bool = False
    alerting: Alerting = field(default_factory=lambda: Alerting("Fan-in", "fan_in"))

    def __post_init__(self) -> None:
        _positive(min_senders=self.min_senders, window_days=self.window_days)


@dataclass(frozen=True)
class FanOut:
    min_recipients: int = 20
    window_days: int = 7
    min_total: float = 0.0
    multiplier: float = 1.5
    types: tuple[str, ...] = ("transfer", "wire")
    internal: bool = True
    counterparties: bool = True
    zero_amounts: bool = False
    alerting: Alerting = field(default_factory=lambda: Alerting("Fan-out", "fan_out"))

    def __post_init__(self) -> None:
        _positive(min_recipients=self.min_recipients, window_days=self.window_days)


@dataclass(frozen=True)
class RapidMovement:
    window_hours: int = 48
    min_received: float = 1000.0
    min_ratio: float = 0.90
    max_retained: float = 0.10
    min_outgoing: int = 1
    high_ratio: float = 0.98
    inbound_types: tuple[str, ...] = ("transfer", "wire", "cash_deposit")
    outbound_types: tuple[str, ...] = ("transfer", "wire", "cash_withdrawal")
    internal: bool = True
    counterparties: bool = True
    zero_amounts: bool = False
    alerting: Alerting = field(default_factory=lambda: Alerting("Rapid movement", "rapid_movement"))

    def __post_init__(self) -> None:
        _positive(window_hours=self.window_hours, min_outgoing=self.min_outgoing)


@dataclass(frozen=True)
class DormantReactivation:
    dormant_days: int = 120
    window_days: int = 7
    min_amount: float = 10_000.0
    min_total: float = 10_000.0
    min_count: int = 1
    high_value_multiplier: float = 2.0
    types: tuple[str, ...] = ("transfer", "wire", "cash_withdrawal")
    internal: bool = True
    counterparties: bool = True
    alerting: Alerting = field(default_factory=lambda: Alerting("Dormant reactivation", "dormant_reactivation"))

    def __post_init__(self) -> None:
        _positive(dormant_days=self.dormant_days, window_days=self.window_days)


@dataclass(frozen=True)
class CircularFlow:
    min_hops: int = 2
    max_hops: int = 4
    min_total: float = 0.0
    max_span_hours: int | None = 168
    types: tuple[str, ...] = ("transfer", "wire")
    counterparty_edges: bool = False
    #: None keeps all.
    max_per_account: int | None = 3
    max_cycles: int | None = 500
    high_amount: float = 50_000.0
    long_hops: int = 4
    alerting: Alerting = field(default_factory=lambda: Alerting("Circular flow", "circular_flow", base_score=85.0))

    def __post_init__(self) -> None:
        if not 2 <= self.min_hops <= self.max_hops:
            raise ValueError("a cycle has at least two hops")
        _positive(max_per_account=self.max_per_account, max_cycles=self.max_cycles)


def normalise_transactions(transactions: DataFrame, zeros: bool = False) -> DataFrame:
    """Clean identifiers, type and amount; rows without id, sender, time or a positive amount go. Adds ``us``.
    ``zeros``: amounts of zero stay; a rule's ``zero_amounts`` asks for that."""
    require_columns(transactions, ("transaction_id", "sender_account_id", "transaction_timestamp", "amount", "transaction_type"), "transactions")
    names = [c for c in ("transaction_id", "sender_account_id", "receiver_account_id", "counterparty_id") if c in transactions.columns]
    clean = transactions.withColumns({c: identifier(F.col(c)) for c in names} | {
        "transaction_timestamp": F.col("transaction_timestamp").cast("timestamp_ntz"),
        "amount": F.col("amount").try_cast("decimal(18,2)"),
        "transaction_type": F.lower(F.trim("transaction_type")),
    })
    clean = clean.withColumn("us", ids.micros(F.col("transaction_timestamp")))
    return clean.filter(F.col("transaction_id").isNotNull() & F.col("sender_account_id").isNotNull() & F.col("us").isNotNull() & (F.col("amount") >= 0 if zeros else F.col("amount") > 0))


def recipient() -> Column:
    return F.coalesce("receiver_account_id", "counterparty_id")


def _not_self() -> Column:
    return F.col("receiver_account_id").isNull() | (F.col("sender_account_id") != F.col("receiver_account_id"))


def near_threshold(c: Structuring) -> Column:
    keep = F.col("transaction_type").isin(*c.types) & (F.col("amount") >= c.reporting_threshold * c.margin) & (F.col("amount") < c.reporting_threshold)
    return keep if c.include_counterparty_payments else keep & F.col("receiver_account_id").isNotNull()


def structuring_candidates(transactions: DataFrame, c: Structuring = Structuring()) -> DataFrame:
    t = normalise_transactions(transactions)
    return t.filter(near_threshold(c)).withColumn("account_id", F.col("sender_account_id")).withColumn("other", F.lit(""))


def fan_in_candidates(transactions: DataFrame, c: FanIn = FanIn()) -> DataFrame:
    t = normalise_transactions(transactions, c.zero_amounts)
    keep = F.col("transaction_type").isin(*c.types) & F.col("receiver_account_id").isNotNull() & _not_self()
    return t.filter(keep).withColumns({"account_id": F.col("receiver_account_id"), "other": F.col("sender_account_id")})


def outgoing(c: FanOut | RapidMovement | DormantReactivation, types: tuple[str, ...]) -> Column:
    keep = F.col("transaction_type").isin(*types) & recipient().isNotNull() & _not_self()
    if not c.internal:
        keep &= F.col("receiver_account_id").isNull()
    if not c.counterparties:
        keep &= F.col("receiver_account_id").isNotNull()
    return keep


def outbound_candidates(transactions: DataFrame, c: FanOut | RapidMovement | DormantReactivation, types: tuple[str, ...], zeros: bool = False) -> DataFrame:
    t = normalise_transactions(transactions, zeros)
    return t.filter(outgoing(c, types)).withColumns({"other": recipient(), "account_id": F.col("sender_account_id")})


def fan_out_candidates(transactions: DataFrame, c: FanOut = FanOut()) -> DataFrame:
    return outbound_candidates(transactions, c, c.types, c.zero_amounts)


def _inbound(c: RapidMovement) -> Column:
    return F.col("transaction_type").isin(*c.inbound_types) & F.col("receiver_account_id").isNotNull()


def rapid_inbound(transactions: DataFrame, c: RapidMovement = RapidMovement()) -> DataFrame:
    return normalise_transactions(transactions, c.zero_amounts).filter(_inbound(c)).withColumns({"account_id": F.col("receiver_account_id"), "other": F.lit("")})


def _sides(t: DataFrame, *sides: tuple[Column, dict[str, Column]]) -> DataFrame:
    """Each transaction once for every side (condition, columns) whose condition it meets, in one pass over them."""
    same = [F.col(c) for c in ("us", "transaction_id", "transaction_timestamp", "amount")]
    made = [F.when(keep, F.struct(*(v.alias(n) for n, v in columns.items()), *same)) for keep, columns in sides]
    return t.select(F.explode(F.array_compact(F.array(*made))).alias("s")).select("s.*")


#: A block of time is this many window widths long; the rows of its first width are copied to the block before.
BLOCK = 4


def _block_of(us: Column, width: int) -> Column:
    """Start of the block that a time is in."""
    return us - F.pmod(us, F.lit(BLOCK * width))


def _blocked(rows: DataFrame, width: int) -> DataFrame:
    """Cuts each account into blocks of time, so that a hub account is as many groups as it has blocks. A row is in its
    own block (``own``), and once more in the block before if a forward window from there can reach it."""
    start = _block_of(F.col("us"), width)
    reach = F.when(F.pmod("us", F.lit(BLOCK * width)) <= width, F.struct((start - BLOCK * width).alias("block"), F.lit(False).alias("own")))
    copies = F.array_compact(F.array(F.struct(start.alias("block"), F.lit(True).alias("own")), reach))
    return rows.withColumn("_b", F.explode(copies)).select("*", "_b.block", "_b.own").drop("_b")


def _forward_sum(value: Column, width: int) -> Column:
    """Sum over the forward window as a difference of two growing frames, each of which is one pass over the
    block; a sliding frame would be summed anew for every row."""
    rows = Window.partitionBy("account_id", "block").orderBy("us")
    upto, before = rows.rangeBetween(Window.unboundedPreceding, width), rows.rangeBetween(Window.unboundedPreceding, -1)
    return F.sum(value).over(upto) - F.coalesce(F.sum(value).over(before), F.lit(0))


def _evidence(strongest: DataFrame, candidates: DataFrame, width: int) -> DataFrame:
    """The transactions inside each account's chosen window, joined by account and block: a window meets two at most."""
    first, last = _block_of(F.col("start_us"), width), _block_of(F.col("start_us") + width, width)
    chosen = strongest.withColumn("block", F.explode(F.array_distinct(F.array(first, last))))
    c = candidates.withColumn("block", _block_of(F.col("us"), width))
    found = chosen.join(c, ["account_id", "block"]).filter((F.col("us") >= F.col("start_us")) & (F.col("us") <= F.col("start_us") + width))
    return found.drop("block")


def _distinct_ahead(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` of blocks with ``strength``: how many distinct others the window from each row holds.

    An other is ahead of just those times that lie at most ``width`` before one of its rows. Each row ends one stretch of
    such times, which begins ``width`` before it, or after the other's row before it. So strength is the number of stretches
    begun by then less those that ended earlier: two running counts, and no set is built for any window."""
    block = ["account_id", "block"]
    previous = F.lag("us").over(Window.partitionBy(*block, "other").orderBy("us"))
    begins = F.greatest(F.col("us") - width, F.coalesce(previous + 1, F.col("us") - width))
    ends = F.struct(F.col("us").alias("at"), F.lit(0).alias("begun"), F.lit(1).alias("ended"))
    stretch = F.struct(begins.alias("at"), F.lit(1).alias("begun"), F.lit(0).alias("ended"))
    # a row of the same other and time as the one before it begins nothing and ends nothing
    events = rows.withColumn("_e", F.when(previous == F.col("us"), F.array(ends.withField("ended", F.lit(0)))).otherwise(F.array(ends, stretch)))
    events = events.select("*", F.explode("_e").alias("e")).select("*", "e.*").drop("_e", "e")
    times = Window.partitionBy(*block).orderBy("at")
    begun = F.sum("begun").over(times.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ended = F.coalesce(F.sum("ended").over(times.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return events.withColumn("strength", begun - ended).filter("begun = 0").drop("at", "begun", "ended")


def _ids_in_order(*before: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("us", *before, "transaction_id"))), lambda x: x["transaction_id"])


def _counted(candidates: DataFrame, width: int, least: int, min_total: float, distinct: bool) -> DataFrame:
    """account_id and its strongest window: most (distinct others, if asked,) transactions, then value, then earliest.
    Distinct others are counted only in blocks that have a window of enough transactions."""
    rows = _blocked(candidates.select("account_id", "us", "other", "amount"), width)
    windows = rows.select("account_id", "block", "own", "us", "other", _forward_sum(F.lit(1), width).alias("n"), _forward_sum(F.col("amount"), width).alias("total"))
    if distinct:
        most = F.max("n").over(Window.partitionBy("account_id", "block"))
        windows = _distinct_ahead(windows.withColumn("_most", most).filter(F.col("_most") >= least), width)
    else:
        windows = windows.withColumn("strength", F.col("n"))
    windows = windows.filter(F.col("own") & (F.col("strength") >= least) & (F.col("total") >= min_total))
    return windows.groupBy("account_id").agg(F.max_by("us", F.struct("strength", "n", "total", -F.col("us"))).alias("start_us"))


def _detections(found: DataFrame, count: str | None = None) -> DataFrame:
    keys = ["account_id"]
    out = found.groupBy(*keys).agg(
        F.min("transaction_timestamp").alias("start"), F.max("transaction_timestamp").alias("end"), F.count("*").alias("transaction_count"), F.sum("amount").alias("total_amount"),
        F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"), F.array_sort(F.collect_set("other")).alias("others"), _ids_in_order().alias("evidence_ids"),
    )
    named = out.withColumns({"detection_window_start": ids.iso(F.col("start")), "detection_window_end": ids.iso(F.col("end"))}).drop("start", "end")
    return named.withColumn(count, F.size("others")) if count else named


def detect_structuring(transactions: DataFrame, c: Structuring = Structuring()) -> DataFrame:
    candidates, width = structuring_candidates(transactions, c), c.window_hours * HOUR
    return _detections(_evidence(_counted(candidates, width, c.min_count, 0, False), candidates, width)).drop("others")


def detect_fan_in(transactions: DataFrame, c: FanIn = FanIn()) -> DataFrame:
    candidates, width = fan_in_candidates(transactions, c), c.window_days * DAY
    found = _detections(_evidence(_counted(candidates, width, c.min_senders, c.min_total, True), candidates, width), "unique_sender_count")
    return found.withColumnRenamed("others", "sender_ids")


def detect_fan_out(transactions: DataFrame, c: FanOut = FanOut()) -> DataFrame:
    candidates, width = fan_out_candidates(transactions, c), c.window_days * DAY
    found = _detections(_evidence(_counted(candidates, width, c.min_recipients, c.min_total, True), candidates, width), "unique_recipient_count")
    return found.withColumnRenamed("others", "recipient_ids")


def detect_rapid_movement(transactions: DataFrame, c: RapidMovement = RapidMovement()) -> DataFrame:
    """Anchors are inbound rows; both directions are summed over one frame of their union."""
    width, t = c.window_hours * HOUR, normalise_transactions(transactions, c.zero_amounts)
    inbound = {"account_id": F.col("receiver_account_id"), "other": F.lit(""), "out": F.lit(0)}
    outbound = {"account_id": F.col("sender_account_id"), "other": recipient(), "out": F.lit(1)}
    both = _sides(t, (_inbound(c), inbound), (outgoing(c, c.outbound_types), outbound))
    received, sent = (_forward_sum(F.when(F.col("out") == k, F.col("amount")).otherwise(0), width) for k in (0, 1))
    blocks = _blocked(both.select("account_id", "us", "out", "amount"), width)
    windows = blocks.select("account_id", "us", "own", "out", received.alias("received"), sent.alias("sent"), _forward_sum(F.col("out"), width).alias("n_out")).filter("own")
    ratio = F.try_divide(F.col("sent").cast("double"), F.col("received").cast("double"))
    retained = F.try_divide(F.greatest(F.col("received") - F.col("sent"), F.lit(0)).cast("double"), F.col("received").cast("double"))
    windows = windows.filter((F.col("out") == 0) & (F.col("received") >= c.min_received) & (F.col("n_out") >= c.min_outgoing)).withColumn("ratio", ratio)
    windows = windows.filter((F.col("ratio") >= c.min_ratio) & (retained <= c.max_retained))
    strongest = windows.groupBy("account_id").agg(F.max_by("us", F.struct("ratio", "sent", "received", -F.col("us"))).alias("start_us"))
    found = _evidence(strongest, both, width)

    def side(k: int, *before: str) -> Column:
        rows = F.collect_list(F.when(F.col("out") == k, F.struct("us", *before, "transaction_id")))
        return F.transform(F.array_sort(rows), lambda x: x["transaction_id"])

    out = found.groupBy("account_id").agg(
        F.min(F.when(F.col("out") == 0, F.col("transaction_timestamp"))).alias("start"),
        F.count(F.when(F.col("out") == 0, 1)).alias("inbound_transaction_count"), F.count(F.when(F.col("out") == 1, 1)).alias("outbound_transaction_count"),
        F.sum(F.when(F.col("out") == 0, F.col("amount"))).alias("total_received"), F.sum(F.when(F.col("out") == 1, F.col("amount"))).alias("total_sent_out"),
        side(0).alias("inbound_evidence_ids"), side(1, "other").alias("outbound_evidence_ids"),
    )
    received, sent = F.col("total_received"), F.col("total_sent_out")
    return out.select(
        "account_id", ids.iso(F.col("start")).alias("detection_window_start"), ids.iso(F.col("start") + F.make_dt_interval(hours=F.lit(c.window_hours))).alias("detection_window_end"),
        "inbound_transaction_count", "outbound_transaction_count", "total_received", "total_sent_out", (sent.cast("double") / received.cast("double")).alias("outflow_ratio"),
        (received - sent).alias("retained_amount"), (F.greatest(received - sent, F.lit(0)).cast("double") / received.cast("double")).alias("retained_ratio"),
        "inbound_evidence_ids", "outbound_evidence_ids", F.concat("inbound_evidence_ids", "outbound_evidence_ids").alias("evidence_ids"),
    )


def activity_history(transactions: DataFrame) -> DataFrame:
    """Every movement of an account, in either direction."""
    t = normalise_transactions(transactions)
    side = lambda c, d: t.filter(F.col(c).isNotNull()).select(F.col(c).alias("account_id"), "transaction_id", "transaction_timestamp", "us", "amount", F.lit(d).alias("activity_direction"))
    return side("sender_account_id", "outbound").unionByName(side("receiver_account_id", "inbound"))


def detect_dormant_reactivation(transactions: DataFrame, c: DormantReactivation = DormantReactivation()) -> DataFrame:
    """As-of lookup of the last strictly earlier movement, and the forward window of candidates, in one partitioning."""
    width, t = c.window_days * DAY, normalise_transactions(transactions)
    candidate = outgoing(c, c.types) & (F.col("amount") >= c.min_amount)
    sent = {"account_id": F.col("sender_account_id"), "other": recipient(), "candidate": candidate.cast("int")}
    received = {"account_id": F.col("receiver_account_id"), "other": F.lit(None).cast("string"), "candidate": F.lit(0)}
    # read for blocks, last movements and evidence: scanned and cleaned once
    moves = checkpointed(_sides(t, (F.lit(True), sent), (F.col("receiver_account_id").isNotNull(), received)))
    # the last movement of each block serves the later blocks; within a block it is a running maximum
    moved = F.struct("us", "transaction_id", "transaction_timestamp")
    start = _block_of(F.col("us"), width).alias("block")
    lasts = moves.groupBy("account_id", start).agg(F.max(moved).alias("last"))
    carry = Window.partitionBy("account_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select("account_id", "block", F.max("last").over(carry).alias("carried"))
    both = _blocked(moves, width).join(lasts, ["account_id", "block"], "left")
    earlier = Window.partitionBy("account_id", "block").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    prior = F.coalesce(F.max(moved).over(earlier), F.col("carried"))
    one = F.col("candidate") == 1
    windows = both.select("account_id", "us", "own", "transaction_timestamp", "candidate", prior.alias("prior"), _forward_sum(F.when(one, F.col("amount")).otherwise(0), width).alias("total"), _forward_sum(F.col("candidate"), width).alias("n"))
    windows = windows.filter("own")
    windows = windows.filter(one & F.col("prior").isNotNull()).withColumn("days", F.datediff("transaction_timestamp", "prior.transaction_timestamp"))
    windows = windows.filter((F.col("days") >= c.dormant_days) & (F.col("n") >= c.min_count) & (F.col("total") >= c.min_total))
    best = windows.groupBy("account_id").agg(F.max_by(F.struct("us", "days", "prior"), F.struct("days", "total", "n", -F.col("us"))).alias("best"))
    strongest = best.select("account_id", F.col("best.us").alias("start_us"), F.col("best.days").alias("dormant_days"), F.col("best.prior").alias("prior"))
    out = _evidence(strongest, moves.filter("candidate = 1"), width).groupBy("account_id", "dormant_days", "prior").agg(
        F.min("transaction_timestamp").alias("start"), F.count("*").alias("reactivation_transaction_count"), F.sum("amount").alias("total_outbound_amount"),
        F.max("amount").alias("max_outbound_amount"), F.count_distinct("other").alias("recipient_count"), _ids_in_order("other").alias("reactivation_evidence_ids"),
    )
    return out.select(
        "account_id", ids.iso(F.col("start")).alias("detection_window_start"), ids.iso(F.col("start") + F.make_dt_interval(days=F.lit(c.window_days))).alias("detection_window_end"),
        F.col("dormant_days").alias("dormant_days_before_activity"), "reactivation_transaction_count", "total_outbound_amount", "max_outbound_amount", "recipient_count",
        ids.iso(F.col("prior.transaction_timestamp")).alias("previous_activity_timestamp"), "reactivation_evidence_ids", F.concat(F.array("prior.transaction_id"), "reactivation_evidence_ids").alias("evidence_ids"),
    )


def circular_edges(transactions: DataFrame, c: CircularFlow = CircularFlow()) -> DataFrame:
    """One edge a transaction; counterparties as CP: nodes if asked for; no self-loops."""
    t = normalise_transactions(transactions).filter(F.col("transaction_type").isin(*c.types))
    target = F.col("receiver_account_id")
    if c.counterparty_edges:
        target = F.coalesce(target, F.concat(F.lit("CP:"), "counterparty_id"))
    edges = t.select(F.col("sender_account_id").alias("source"), target.alias("target"), "transaction_id", "transaction_timestamp", "us", "amount")
    return edges.filter(F.col("target").isNotNull() & (F.col("source") != F.col("target")))


def simple_cycles(edges: DataFrame, min_hops: int, max_hops: int) -> DataFrame:
    """accounts: the nodes of every simple cycle, smallest first. edges: distinct source, target.

    A path starts at its smallest node and every further node is larger, so each cycle is found once, in its
    canonical rotation, and a path never grows beyond ``max_hops``. Nodes that can't lie on a cycle, having
    no edge in or none out, leave first."""
    both_ways = edges.select(F.col("source").alias("n")).distinct().join(edges.select(F.col("target").alias("n")).distinct(), "n")
    edges = edges.join(both_ways.withColumnRenamed("n", "source"), "source", "left_semi").join(both_ways.withColumnRenamed("n", "target"), "target", "left_semi").select("source", "target")
    paths = edges.filter(F.col("source") < F.col("target")).select(F.array("source", "target").alias("accounts"), F.col("target").alias("at"))
    found = []
    for hops in range(2, max_hops + 1):
        first = F.col("accounts")[0]
        if hops >= min_hops:
            closing = edges.select(F.col("source").alias("at"), F.col("target").alias("back"))
            found.append(paths.join(closing, (paths["at"] == closing["at"]) & (first == closing["back"]), "left_semi").select("accounts"))
        if hops < max_hops:
            step = edges.select(F.col("source").alias("at"), F.col("target").alias("next"))
            grown = paths.join(step, "at").filter((F.col("next") > first) & ~F.array_contains("accounts", F.col("next")))
            paths = grown.select(F.concat("accounts", F.array("next")).alias("accounts"), F.col("next").alias("at"))
    return reduce(DataFrame.unionByName, found)


def detect_circular_flow(transactions: DataFrame, c: CircularFlow = CircularFlow()) -> DataFrame:
    """Cycles with all transactions of their steps as evidence; filtered by value and span, then the first few
    of each account and in all."""
    # read by every hop and for the evidence: scanned and cleaned once
    edges = checkpointed(circular_edges(transactions, c))
    cycles = simple_cycles(checkpointed(edges.select("source", "target").distinct()), c.min_hops, c.max_hops)
    steps = cycles.select("accounts", F.posexplode("accounts").alias("step", "source")).withColumn("target", F.element_at("accounts", F.pmod(F.col("step") + 1, F.size("accounts")) + 1))
    out = steps.join(edges, ["source", "target"]).groupBy("accounts").agg(
        F.min("transaction_timestamp").alias("start"), F.max("transaction_timestamp").alias("end"), ((F.max("us") - F.min("us")) / HOUR).alias("time_span_hours"), F.count("*").alias("transaction_count"),
        F.sum("amount").alias("total_amount"), F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"), F.transform(F.array_sort(F.collect_list(F.struct("step", "us", "transaction_id"))), lambda x: x["transaction_id"]).alias("evidence_ids"),
    )
    out = out.filter(F.col("total_amount") >= c.min_total)
    if c.max_span_hours is not None:
        out = out.filter(F.col("time_span_hours") <= c.max_span_hours)
    out = out.select(
        ids.cycle_id(F.col("accounts"), F.col("evidence_ids")).alias("cycle_id"), F.col("accounts")[0].alias("account_id"), F.col("accounts").alias("cycle_accounts"), F.size("accounts").alias("cycle_length"),
        ids.iso(F.col("start")).alias("detection_window_start"), ids.iso(F.col("end")).alias("detection_window_end"), "time_span_hours", "transaction_count", "total_amount", "min_amount", "max_amount", "evidence_ids",
        F.array_join(F.concat("accounts", F.array(F.col("accounts")[0])), " -> ").alias("cycle_path"),
    )
    order = ["cycle_length", "detection_window_start", "cycle_id"]
    if c.max_per_account is not None:
        out = out.withColumn("_k", F.row_number().over(Window.partitionBy("account_id").orderBy(*order))).filter(F.col("_k") <= c.max_per_account).drop("_k")
    return out if c.max_cycles is None else out.orderBy("account_id", *order).limit(c.max_cycles)


def last_customers(accounts: DataFrame) -> DataFrame:
    """account_id, customer_id of the last row of each account: the newest by the columns that say so, else the last read."""
    said = [c for c in ("updated_at", "ingested_at", "raw_record_id") if c in accounts.columns]
    last = F.struct(*(said or ["_read"]))
    return accounts.withColumn("_read", F.monotonically_increasing_id()).groupBy(identifier(F.col("account_id")).alias("account_id")).agg(F.max_by("customer_id", last).alias("customer_id"))


def attach_customers(detections: DataFrame, accounts: DataFrame) -> DataFrame:
    """Left join by account, of which the last row counts. The larger side is never multiplied."""
    return detections.join(last_customers(accounts), "account_id", "left")


def templated(template: str, **values: Column) -> Column:
    """A template's text with {name} replaced by values."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.lit(x) if k % 2 == 0 else values[x].cast("string") for k, x in enumerate(parts)))


# The reasons' wording.
def count_reason(count: Column, unit: str, window: int, window_unit: str, template: str | None = None) -> Column:
    if template is not None:
        return templated(template, count=count, unit_label=F.lit(unit), window_value=F.lit(window), window_unit=F.lit(window_unit))
    return F.concat(count.cast("string"), F.lit(f" {unit} within {window} {window_unit}"))


def rapid_reason(ratio: Column, hours: int, template: str | None = None) -> Column:
    percent = F.bround(ratio * 100).cast("long")
    if template is not None:
        return templated(template, outflow_ratio=ratio, outflow_percentage=percent, outflow_ratio_pct=percent, outgoing_ratio_pct=percent, window_hours=F.lit(hours))
    return F.concat(percent.cast("string"), F.lit(f" percent of received value sent out within {hours} hours"))


def dormant_reason(days: Column, total: Column, window: int, template: str | None = None) -> Column:
    money = total.cast("decimal(28,2)")
    if template is not None:
        return templated(template, dormant_days=days, total_outbound_amount=total.cast("double"), total_outbound_amount_formatted=money, reactivation_window_days=F.lit(window))
    return F.concat(days.cast("string"), F.lit(" inactive days followed by "), money.cast("string"), F.lit(f" outbound value within {window} days"))


def circular_reason(length: Column, total: Column, hours: Column, template: str | None = None) -> Column:
    money, span = total.cast("decimal(28,2)"), F.format_string("%.1f", hours)
    if template is not None:
        return templated(template, cycle_length=length, total_amount=total.cast("double"), total_amount_formatted=money, time_span_hours=hours, time_span_hours_formatted=span)
    return F.concat(length.cast("string"), F.lit("-account circular flow with "), money.cast("string"), F.lit(" total value"), F.when(hours.isNull(), "").otherwise(F.concat(F.lit(" over "), span, F.lit(" hours"))))


def to_alerts(detections: DataFrame, accounts: DataFrame, a: Alerting, raised: Column, reason: Column, run: str | None = None) -> DataFrame:
    d = detections.withColumns({"_raised": raised, "_reason": reason}).select("account_id", "detection_window_start", "detection_window_end", "evidence_ids", "_raised", "_reason")
    d = attach_customers(d, accounts)
    return d.select(
        ids.alert_id(a.rule_name, F.col("account_id"), F.col("detection_window_start"), F.col("evidence_ids")).alias("alert_id"), "account_id", "customer_id", F.lit(a.rule_name).alias("rule_name"),
        F.lit(a.typology).alias("typology"), F.lit(a.severity).alias("severity"), F.when(F.col("_raised"), a.raised_score).otherwise(a.base_score).alias("risk_score_rule"), F.col("_reason").alias("reason_code"),
        "evidence_ids", "detection_window_start", "detection_window_end", F.lit(run).cast("string").alias("model_run_id"), F.lit("New").alias("alert_status"),
    )


def structuring_alerts(transactions: DataFrame, accounts: DataFrame, c: Structuring = Structuring(), run: str | None = None) -> DataFrame:
    n = F.col("transaction_count")
    return to_alerts(detect_structuring(transactions, c), accounts, c.alerting, n >= c.min_count * c.high_count_multiplier, F.concat(n.cast("string"), F.lit(f" transfers below threshold within {c.window_hours} hours")), run)


def fan_in_alerts(transactions: DataFrame, accounts: DataFrame, c: FanIn = FanIn(), run: str | None = None) -> DataFrame:
    n = F.col("unique_sender_count")
    return to_alerts(detect_fan_in(transactions, c), accounts, c.alerting, n >= c.min_senders * c.multiplier, count_reason(n, "unique senders", c.window_days, "days", c.alerting.template), run)


def fan_out_alerts(transactions: DataFrame, accounts: DataFrame, c: FanOut = FanOut(), run: str | None = None) -> DataFrame:
    n = F.col("unique_recipient_count")
    return to_alerts(detect_fan_out(transactions, c), accounts, c.alerting, n >= c.min_recipients * c.multiplier, count_reason(n, "unique recipients", c.window_days, "days", c.alerting.template), run)


def rapid_alerts(transactions: DataFrame, accounts: DataFrame, c: RapidMovement = RapidMovement(), run: str | None = None) -> DataFrame:
    r = F.col("outflow_ratio")
    return to_alerts(detect_rapid_movement(transactions, c), accounts, c.alerting, r >= c.high_ratio, rapid_reason(r, c.window_hours, c.alerting.template), run)


def dormant_alerts(transactions: DataFrame, accounts: DataFrame, c: DormantReactivation = DormantReactivation(), run: str | None = None) -> DataFrame:
    total = F.col("total_outbound_amount")
    return to_alerts(detect_dormant_reactivation(transactions, c), accounts, c.alerting, total >= c.min_total * c.high_value_multiplier, dormant_reason(F.col("dormant_days_before_activity"), total, c.window_days, c.alerting.template), run)


def circular_alerts(transactions: DataFrame, accounts: DataFrame, c: CircularFlow = CircularFlow(), run: str | None = None) -> DataFrame:
    raised = (F.col("total_amount") >= c.high_amount) | (F.col("cycle_length") >= c.long_hops)
    return to_alerts(detect_circular_flow(transactions, c), accounts, c.alerting, raised, circular_reason(F.col("cycle_length"), F.col("total_amount"), F.col("time_span_hours"), c.alerting.template), run)


#: Rules in their canonical order, and other names they go by.
REGISTRY = {
    "structuring": (structuring_alerts, Structuring),
    "fan_in": (fan_in_alerts, FanIn),
    "fan_out": (fan_out_alerts, FanOut),
    "rapid_movement": (rapid_alerts, RapidMovement),
    "circular_flow": (circular_alerts, CircularFlow),
    "dormant_reactivation": (dormant_alerts, DormantReactivation),
}
ALIASES = {"smurfing": "structuring", "rapid": "rapid_movement", "circular": "circular_flow", "dormant": "dormant_reactivation"}


def rule_key(name: str) -> str:
    key = name.strip().lower().replace("-", "_").replace(" ", "_")
    key = ALIASES.get(key, key)
    if key not in REGISTRY:
        raise ValueError(f"unknown rule {name}")
    return key


def enabled_rules(requested: list[str] | None = None, disabled: list[str] | None = None) -> list[str]:
    """In canonical order."""
    chosen = {rule_key(x) for x in requested} if requested is not None else set(REGISTRY)
    return [k for k in REGISTRY if k in chosen - {rule_key(x) for x in disabled or []}]


def run_rules(transactions: DataFrame, accounts: DataFrame, rules: list[str] | None = None, configs: dict | None = None, disabled: list[str] | None = None, run: str | None = None) -> DataFrame:
    """The union of the enabled rules' alerts."""
    keys = enabled_rules(rules, disabled)
    if not keys:
        raise ValueError("no rule is enabled")
    return reduce(DataFrame.unionByName, [REGISTRY[k][0](transactions, accounts, (configs or {}).get(k, REGISTRY[k][1]()), run) for k in keys])


def alert_summary(alerts: DataFrame) -> DataFrame:
    """dimension, value, alert_count over severity, rule and typology: one pass over grouping sets."""
    sets = alerts.groupingSets([["severity"], ["rule_name"], ["typology"]], "severity", "rule_name", "typology").agg(F.grouping_id().alias("g"), F.count("*").alias("alert_count"))
    name = F.when(F.col("g") == 3, "severity").when(F.col("g") == 5, "rule_name").otherwise("typology")
    return sets.select(name.alias("dimension"), F.coalesce("severity", "rule_name", "typology").alias("value"), "alert_count")


def alert_problem(alert: str | None = None) -> Column:
    """What is wrong with an alert record, or null: the first rule that it breaks."""
    c = lambda name: F.col(f"{alert}.{name}" if alert else name)
    blank = lambda name: c(name).isNull() | (F.trim(c(name)) == "")
    out = F.when(blank("alert_id"), "no alert_id")
    for name in ("account_id", "rule_name", "reason_code"):
        out = out.when(blank(name), f"no {name}")
    out = out.when(~F.coalesce(F.lower(c("severity")).isin("low", "medium", "high", "critical"), F.lit(False)), "no such severity")
    out = out.when(~F.coalesce(c("risk_score_rule").between(0, 100), F.lit(False)), "score beyond 0 to 100")
    return out.when(F.coalesce(F.size("evidence_ids" if not alert else f"{alert}.evidence_ids"), F.lit(0)) < 1, "no evidence")


def alert_violations(alerts: DataFrame) -> DataFrame:
    """alert_id, account_id, problem of every record that breaks a rule, copies of an id included."""
    copies = alerts.groupBy("alert_id").agg(F.count("*").alias("_n")).filter("_n > 1 AND alert_id IS NOT NULL").select("alert_id", F.lit("repeated alert_id").alias("_again"))
    found = alerts.join(copies, "alert_id", "left").withColumn("problem", F.coalesce(alert_problem(), F.col("_again")))
    return found.filter("problem IS NOT NULL").select("alert_id", "account_id", "problem")


def enforced(alerts: DataFrame) -> DataFrame:
    """``alerts`` that can't be written or read while a record breaks its rules: whatever uses the id evaluates them."""
    text = F.concat(F.lit("invalid alert "), F.coalesce("alert_id", F.lit("?")), F.lit(": "), alert_problem())
    return alerts.withColumn("alert_id", F.when(alert_problem().isNull(), F.col("alert_id")).otherwise(F.raise_error(text).cast("string")))


def invalid_alerts(alerts: DataFrame, copies: bool = True) -> DataFrame:
    """Alerts that break the record's rules: they must be none. ``copies``: records that share an id break them too; ids have eight
    hex digits, so among tens of thousands of alerts some share one by chance."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    bad = blank("alert_id") | blank("account_id") | blank("rule_name") | blank("reason_code") | ~F.col("severity").isin("low", "medium", "high", "critical") | ~F.col("risk_score_rule").between(0, 100) | (F.size("evidence_ids") < 1)
    if not copies:
        return alerts.filter(bad)
    again = F.count("*").over(Window.partitionBy("alert_id"))
    return alerts.withColumns({"_bad": bad, "_copies": again}).filter(F.col("_bad") | (F.col("_copies") > 1)).drop("_bad", "_copies")
