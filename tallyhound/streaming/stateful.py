"""Structuring and dormant reactivation over a stream of transactions: the detections of the batch rules, as time goes on.

An account's rows wait in its state until no more can fall into the windows that start at them, which is when the watermark
has passed their ends; a timer says when. Such windows are then judged once, their starts leave the state, and a detection
goes out whenever the account's strongest window so far is beaten. The newest detection of each account (``newest``) is
the batch rule's over all rows seen.

Late rows count as long as they are newer than the watermark; older ones are dropped, as nothing that they could change is
still open. Rows of the last window wait for later time: a stream that ends wants one more row of any kind
(``transaction_type`` may be anything) that is newer by a window and the lateness. An account's state is its rows of one
window and the lateness, and four small values; accounts are kept in groups by hash, and a batch rewrites the states of the groups
that it touches. All of it is in RocksDB and in the query's checkpoint, so that a lost executor's accounts go on elsewhere.
Rows without id, sender, time or a positive amount are left out, as in the batch rules.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyhound.functions import ids
from tallyhound.operators import rules

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Accounts are dealt to so many groups by hash, each with one state: a call a group costs milliseconds, whatever it holds.
GROUPS = 256
#: A waiting row: account, time, id, other side, amount in cents, 1 if the rule counts it.
ROW = ("account_id", "us", "transaction_id", "other", "cents", "counted")
#: What is known of an account: the number and strength of its last detection, and its last movement before its waiting rows.
MEMORY = ("known", "place", "strength", "prior_us", "prior_id")
STATE = (
    "account_id array<string>, us array<long>, transaction_id array<string>, other array<string>, cents array<long>, counted array<int>, "
    "known array<string>, place array<long>, strength array<string>, prior_us array<long>, prior_id array<string>"
)
FOUND = (
    "account_id string, place long, start_us long, end_us long, transaction_count long, total string, least string, most string, "
    "others long, days int, prior_us long, prior_id string, evidence_ids array<string>"
)


def _money(cents: int) -> str:
    return f"{cents // 100}.{cents % 100:02d}"


class _Forward:
    """Judges forward windows of ``width`` microseconds once they are over. ``strength`` ranks one of them, or refuses it."""

    def __init__(self, width: int, least: int, min_cents: int = 0) -> None:
        self.width, self.least, self.min_cents = width, least, min_cents

    def __call__(self, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get) if state.exists else [[] for _ in range(len(ROW) + len(MEMORY))]
        rows, memory = list(zip(*kept[: len(ROW)])), {m[0]: m[1:] for m in zip(*kept[len(ROW) :])}
        if not state.hasTimedOut:
            for batch in batches:
                rows.extend(zip(*(batch[c].tolist() for c in ROW)))
        rows.sort()
        ended = state.getCurrentWatermarkMs() * 1000 - self.width - 1
        waiting, found, first = [], [], None
        for account, own in groupby(rows, itemgetter(0)):
            own = [r[1:] for r in own]
            times = [r[0] for r in own]
            # a window whose end the watermark has passed is judged at once, after the rows that came with it
            over = bisect_right(times, ended)
            if over:
                place, strength, us, transaction_id = memory.get(account, (0, "", None, None))
                best = tuple(map(int, strength.split(","))) if strength else ()
                better, best = self._judge(own, times, over, None if us is None else (us, transaction_id), best)
                if better:
                    place += 1
                    found.append({"account_id": account, "place": place, **better})
                memory[account] = (place, ",".join(map(str, best)), *own[over - 1][:2])
            if over < len(own):
                waiting.extend((account, *r) for r in own[over:])
                first = times[over] if first is None else min(first, times[over])
        columns = lambda tuples, names: [list(c) for c in zip(*tuples)] or [[] for _ in names]
        state.update((*columns(waiting, ROW), *columns(((k, *m) for k, m in memory.items()), MEMORY)))
        if first is not None:
            state.setTimeoutTimestamp((first + self.width) // 1000 + 1)
        if found:
            yield pd.DataFrame(found)

    def _judge(self, rows: list[tuple], times: list[int], over: int, prior: tuple | None, best: tuple) -> tuple[dict | None, tuple]:
        """The strongest of the windows that start at the first ``over`` rows, if it beats ``best``; and the best by now."""
        if not over:
            return None, best
        chosen = None
        counts, sums = ([0, *accumulate(x)] for x in ((r[4] for r in rows), (r[3] * r[4] for r in rows)))
        first = 0
        while first < over:
            us = times[first]
            after, end = bisect_right(times, us, first), bisect_right(times, us + self.width, first)
            n, total = counts[end] - counts[first], sums[end] - sums[first]
            if counts[after] > counts[first] and n >= self.least and total >= self.min_cents:
                strength = self.strength(us, n, total, prior)
                if strength is not None and strength > best:
                    best, chosen = strength, (first, end, prior)
            prior, first = rows[after - 1][:2], after
        if chosen is None:
            return None, best
        first, end, prior = chosen
        return self.found(times[first], [r for r in rows[first:end] if r[4]], prior), best

    def strength(self, us: int, n: int, total: int, prior: tuple | None) -> tuple | None:
        return (n, total, -us)

    def found(self, us: int, inside: list[tuple], prior: tuple | None) -> dict:
        cents = [r[3] for r in inside]
        return {
            "start_us": us, "end_us": inside[-1][0], "transaction_count": len(inside), "total": _money(sum(cents)), "least": _money(min(cents)), "most": _money(max(cents)),
            "others": len({r[2] for r in inside}), "days": 0, "prior_us": 0, "prior_id": "", "evidence_ids": [r[1] for r in inside],
        }


class _Dormant(_Forward):
    """Windows after a long pause; ``prior`` is the account's last movement before its waiting rows."""

    def __init__(self, width: int, least: int, min_cents: int, dormant_days: int) -> None:
        super().__init__(width, least, min_cents)
        self.dormant_days = dormant_days

    def strength(self, us: int, n: int, total: int, prior: tuple | None) -> tuple | None:
        days = -1 if prior is None else us // rules.DAY - prior[0] // rules.DAY
        return (days, total, n, -us) if days >= self.dormant_days else None

    def found(self, us: int, inside: list[tuple], prior: tuple | None) -> dict:
        in_order = sorted(inside, key=lambda r: (r[0], r[2], r[1]))
        days = us // rules.DAY - prior[0] // rules.DAY
        return super().found(us, inside, prior) | {"days": days, "prior_us": prior[0], "prior_id": prior[1], "evidence_ids": [r[1] for r in in_order]}


def _timed(transactions: DataFrame, late: str) -> DataFrame:
    us = ids.micros(F.col("transaction_timestamp").cast("timestamp_ntz"))
    return rules.normalise_transactions(transactions.withColumn("at", F.timestamp_micros(us)).withWatermark("at", late))


def _detect(rows: DataFrame, judge: _Forward) -> DataFrame:
    cents = (F.col("amount") * 100).cast("long").alias("cents")
    group = F.pmod(F.xxhash64("account_id"), F.lit(GROUPS)).alias("group")
    rows = rows.select(group, "at", "account_id", "us", "transaction_id", F.coalesce("other", F.lit("")).alias("other"), cents, "counted")
    return rows.groupBy("group").applyInPandasWithState(judge.__call__, FOUND, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def structuring_stream(transactions: DataFrame, c: rules.Structuring = rules.Structuring(), late: str = "1 day") -> DataFrame:
    """Detections of ``detect_structuring`` over a stream, in the form of ``FOUND``."""
    t = _timed(transactions, late)
    # asks for ``at`` too: otherwise the filter would go below the watermark, and rows that no rule counts would not move time on
    counted = F.when(F.col("at").isNotNull(), rules.near_threshold(c)).otherwise(F.lit(False))
    t = t.filter(counted).withColumns({"account_id": F.col("sender_account_id"), "other": F.lit(""), "counted": F.lit(1)})
    return _detect(t, _Forward(c.window_hours * rules.HOUR, c.min_count))


def dormant_stream(transactions: DataFrame, c: rules.DormantReactivation = rules.DormantReactivation(), late: str = "1 day") -> DataFrame:
    """Detections of ``detect_dormant_reactivation`` over a stream, in the form of ``FOUND``. Every movement counts as one,
    so each is sent to both its accounts."""
    t = _timed(transactions, late)
    counted = F.coalesce(rules.outgoing(c, c.types) & (F.col("amount") >= c.min_amount), F.lit(False)).cast("int")
    sent = F.struct(F.col("sender_account_id").alias("account_id"), rules.recipient().alias("other"), counted.alias("counted"))
    received = F.struct(F.col("receiver_account_id").alias("account_id"), F.lit(None).cast("string").alias("other"), F.lit(0).alias("counted"))
    sides = F.array_compact(F.array(sent, F.when(F.col("receiver_account_id").isNotNull(), received)))
    moves = t.withColumn("_s", F.explode(sides)).select("at", "us", "transaction_id", "amount", "_s.*")
    return _detect(moves, _Dormant(c.window_days * rules.DAY, c.min_count, round(c.min_total * 100), c.dormant_days))


def newest(found: DataFrame) -> DataFrame:
    """Of all detections that went out, the last of each account."""
    rest = [c for c in found.columns if c != "account_id"]
    return found.groupBy("account_id").agg(F.max_by(F.struct(*rest), "place").alias("f")).select("account_id", "f.*")


def _at(column: str) -> Column:
    return F.timestamp_micros(column).cast("timestamp_ntz")


def structuring_detections(found: DataFrame) -> DataFrame:
    """The columns of the batch rule."""
    money = {x: F.col(y).cast(t) for x, y, t in (("total_amount", "total", "decimal(28,2)"), ("min_amount", "least", "decimal(18,2)"), ("max_amount", "most", "decimal(18,2)"))}
    at = {"detection_window_start": ids.iso(_at("start_us")), "detection_window_end": ids.iso(_at("end_us"))}
    return found.select("account_id", "transaction_count", *[v.alias(k) for k, v in (money | at).items()], "evidence_ids")


def dormant_detections(found: DataFrame, c: rules.DormantReactivation = rules.DormantReactivation()) -> DataFrame:
    """The columns of the batch rule."""
    end = _at("start_us") + F.make_dt_interval(days=F.lit(c.window_days))
    return found.select(
        "account_id", ids.iso(_at("start_us")).alias("detection_window_start"), ids.iso(end).alias("detection_window_end"), F.col("days").alias("dormant_days_before_activity"),
        F.col("transaction_count").alias("reactivation_transaction_count"), F.col("total").cast("decimal(28,2)").alias("total_outbound_amount"), F.col("most").cast("decimal(18,2)").alias("max_outbound_amount"),
        F.col("others").alias("recipient_count"), ids.iso(_at("prior_us")).alias("previous_activity_timestamp"), F.col("evidence_ids").alias("reactivation_evidence_ids"),
        F.concat(F.array("prior_id"), "evidence_ids").alias("evidence_ids"),
    )


def start(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Detections as Parquet at ``path``, of all that has come by now; started again with the same ``checkpoint`` it goes on
    where it was."""
    found.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
