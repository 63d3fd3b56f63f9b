"""Account-day features.

A transaction at ts counts for date D in an N-day window if D - N days < ts <= D + 1 day. So transactions are summed
by account and day first, each sum is copied to the at most N + 1 dates it affects where its account's days are, and
counterparties are followed by their changes: no range join, and no account's transactions meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.functions.normalise import identifier

RATIO_CAP = 999_999.0


@dataclass(frozen=True)
class FeatureConfig:
    version: str = "account_features_v1"
    daily: int = 1
    weekly: int = 7
    monthly: int = 30
    threshold: float = 10_000.0
    margin: float = 0.95
    min_date: str | None = None
    max_date: str | None = None
    all_accounts: bool = True

    def __post_init__(self) -> None:
        if not 0 < self.daily <= self.weekly <= self.monthly:
            raise ValueError("windows are positive and in order")
        if not 0 < self.margin < 1 or self.threshold <= 0:
            raise ValueError("the margin is between 0 and 1, the threshold positive")


def prepared(transactions: DataFrame) -> DataFrame:
    """Clean identifiers, and the recipient key: receiver, else counterparty, else a mark."""
    t = transactions.withColumns({c: identifier(F.col(c)) for c in ("sender_account_id", "receiver_account_id", "counterparty_id")})
    t = t.withColumns({"ts": F.col("transaction_timestamp").cast("timestamp_ntz"), "amount": F.col("amount").try_cast("decimal(18,2)")})
    return t.filter(F.col("ts").isNotNull() & F.col("amount").isNotNull()).withColumn("recipient_key", F.coalesce("receiver_account_id", "counterparty_id", F.lit("<missing_recipient>")))


def movements(transactions: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """One row an account and transaction: what it sent and received in it. A self-transfer is one row with both."""
    t = prepared(transactions)
    if weights is not None:
        w = F.broadcast(weights)  # one row a country
        for side in ("origin", "destination"):
            t = t.join(w.select(F.col("country_code").alias(f"{side}_country"), F.col("weight").alias(f"{side}_weight")), f"{side}_country", "left")
        t = t.withColumn("weight", F.greatest(F.coalesce("origin_weight", F.lit(0.0)), F.coalesce("destination_weight", F.lit(0.0))))
    sides = F.when(F.col("sender_account_id") == F.col("receiver_account_id"), F.array("sender_account_id")).otherwise(F.array_compact(F.array("sender_account_id", "receiver_account_id")))
    m = t.withColumn("account_id", F.explode(sides))
    out, into = F.col("account_id") == F.col("sender_account_id"), F.col("account_id") == F.col("receiver_account_id")
    return m.withColumns({
        "sent": F.when(out, F.col("amount")), "received": F.when(into, F.col("amount")),
        "out_key": F.when(out, F.col("recipient_key")), "in_key": F.when(into, F.col("sender_account_id")),
    })


def country_weights(countries: DataFrame) -> DataFrame:
    """risk_score / 100, else 1 for a high-risk flag, clipped to 0 to 1."""
    weight = F.coalesce(F.col("risk_score") / 100, F.when(F.col("is_high_risk"), 1.0).otherwise(0.0))
    return countries.select("country_code", F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight)).alias("weight"))


def date_spine(transactions: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """feature_date: every day from the first to the last transaction, or between the dates configured."""
    days = transactions.agg(F.min("transaction_timestamp").cast("date").alias("a"), F.max("transaction_timestamp").cast("date").alias("b"))
    first, last = (F.lit(x).cast("date") if x else F.col(c) for x, c in ((config.min_date, "a"), (config.max_date, "b")))
    return days.select(F.explode(F.sequence(first, last)).alias("feature_date"))


def account_universe(accounts: DataFrame, transactions: DataFrame, all_accounts: bool = True) -> DataFrame:
    active = prepared(transactions).select(F.explode(F.array_compact(F.array("sender_account_id", "receiver_account_id"))).alias("account_id")).distinct()
    listed = accounts.dropDuplicates(["account_id"])
    return listed.join(active, "account_id", "left") if all_accounts else listed.join(active, "account_id", "left_semi")


def effective_day() -> Column:
    """The day e of a transaction with which it counts for date D in an N-day window just if D - N <= e <= D:
    its calendar day, or the day before where it falls on midnight."""
    day = F.col("ts").cast("date")
    return F.when(F.col("ts") == F.date_trunc("day", "ts").cast("timestamp_ntz"), F.date_sub(day, 1)).otherwise(day)


def _bounds(transactions: DataFrame, c: FeatureConfig) -> DataFrame:
    """One row: the first and the last date of the spine."""
    return F.broadcast(date_spine(transactions, c).agg(F.min("feature_date").alias("_from"), F.max("feature_date").alias("_to")))


def _on_dates(rows: DataFrame, bounds: DataFrame, days: int) -> DataFrame:
    """A day's rows once for every date of the spine whose window of ``days`` holds the day."""
    until = F.date_add("e", days)
    some = rows.crossJoin(bounds).filter((F.col("e") <= F.col("_to")) & (until >= F.col("_from")))
    return some.withColumn("feature_date", F.explode(F.sequence(F.greatest("e", "_from"), F.least(until, F.col("_to"))))).drop("_from", "_to")


def daily_sums(m: DataFrame, c: FeatureConfig = FeatureConfig()) -> DataFrame:
    """One row an account and effective day: all that the windows need of it but the counterparties."""
    near = (F.col("sent") >= c.threshold * c.margin) & (F.col("sent") < c.threshold)
    zero = F.lit(0).cast("decimal(28,2)")
    return m.groupBy("account_id", "e").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("sent"), zero).alias("sent"), F.coalesce(F.sum("received"), zero).alias("received"),
        F.sum("amount").alias("amount"), F.max("amount").alias("largest"), F.count(F.when(near, 1)).alias("near"),
        F.count(F.when(F.col("is_cross_border"), 1)).alias("abroad"), F.sum(F.col("amount").cast("double") * F.col("weight")).alias("exposed"),
        F.min("ts").alias("first"), F.max("ts").alias("last"),
    )


def counterparty_days(m: DataFrame) -> DataFrame:
    """One row an account, effective day and counterparty, with the number of transactions sent to it (0: only received from)."""
    keys = F.array(F.struct(F.col("out_key").alias("key"), F.lit(1).alias("out")), F.struct(F.col("in_key").alias("key"), F.lit(0).alias("out")))
    pairs = m.select("account_id", "e", F.explode(keys).alias("k")).select("account_id", "e", "k.*").filter(F.col("key").isNotNull())
    return pairs.groupBy("account_id", "e", "key").agg(F.sum("out").alias("n"))


def counterparties(days: DataFrame, spine: DataFrame, bounds: DataFrame, c: FeatureConfig) -> DataFrame:
    """Counterparties of the week and their entropy over the month for each row of ``spine``, from ``counterparty_days``.

    No counterparty is copied to the dates it counts for: it makes a row where its week begins or ends and where its count in the month
    changes, and those are summed up along an account's dates."""
    in_order = Window.partitionBy("account_id", "key").orderBy("e")
    gap = lambda a, b: F.coalesce(F.datediff(b, a) > c.weekly, F.lit(True)).cast("int")
    change = lambda after, n, week: F.struct(F.date_add("e", after).alias("at"), n.cast("long").alias("n"), week.cast("int").alias("week"))
    none = F.lit(0)
    ways = F.array(change(0, F.col("n"), gap(F.lag("e").over(in_order), F.col("e"))), change(c.weekly + 1, none, -gap(F.col("e"), F.lead("e").over(in_order))), change(c.monthly + 1, -F.col("n"), none))
    changes = days.withColumn("ways", ways).select("account_id", "key", F.explode("ways").alias("w")).select("account_id", "key", "w.*").filter("n <> 0 OR week <> 0")
    changes = changes.crossJoin(bounds).filter(F.col("at") <= F.col("_to"))
    changes = changes.groupBy("account_id", "key", "at", "_from").agg(F.sum("n").alias("n"), F.sum("week").alias("week"))
    now = F.sum("n").over(Window.partitionBy("account_id", "key").orderBy("at"))
    # -sum(p ln p) of counts n with total N is ln N - sum(n ln n) / N
    spread = lambda n: F.when(n > 0, n * F.ln(n)).otherwise(0.0)
    changes = changes.withColumn("now", now).select("account_id", F.greatest("at", "_from").alias("feature_date"), "n", "week", (spread(F.col("now")) - spread(F.col("now") - F.col("n"))).alias("spread"))
    keys = ["account_id", "feature_date"]
    sums = changes.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("week").alias("week"), F.sum("spread").alias("spread"))
    upto = Window.partitionBy("account_id").orderBy("feature_date")
    so_far = spine.join(sums, keys, "left").select(*keys, *[F.sum(x).over(upto).alias(x) for x in ("n", "week", "spread")])
    entropy = F.when(F.col("n") > 0, F.greatest(F.lit(0.0), F.ln("n") - F.col("spread") / F.col("n")))
    return so_far.select(*keys, F.col("week").cast("int").alias("unique_counterparties_7d"), entropy.alias("counterparty_entropy"))


def account_features(accounts: DataFrame, transactions: DataFrame, countries: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """The 14 features of every account and day.

    Transactions are summed by account and day, and by account, day and counterparty, before any row is copied to the
    dates it counts for: an account costs its active days and counterparties, however many transactions it has."""
    c = config
    columns = ["account_id", "ts", "amount", "sent", "received", "out_key", "in_key", "is_cross_border", "weight"]
    m = movements(transactions, country_weights(countries)).select(*columns, effective_day().alias("e"))
    daily = daily_sums(m, c)
    keys = ["account_id", "feature_date"]
    age = F.datediff("feature_date", "e")
    within = lambda x, days: F.sum(F.when(age <= days, F.col(x)).otherwise(F.lit(0)))
    n, amount = F.sum("n").cast("double"), F.sum("amount").cast("double")
    bounds = _bounds(transactions, c)
    # dealt by account before a day is copied to its dates, so that copies are summed where they are made
    base = _on_dates(daily.repartition("account_id"), bounds, c.monthly).groupBy(*keys).agg(
        within("n", c.daily).alias("txn_count_1d"), within("n", c.weekly).alias("txn_count_7d"),
        within("sent", c.weekly).cast("decimal(28,2)").alias("total_sent_7d"), within("received", c.weekly).cast("decimal(28,2)").alias("total_received_7d"),
        (amount / n).alias("avg_txn_amount_30d"), F.max("largest").alias("max_txn_amount_30d"), within("near", c.daily).alias("below_threshold_count_24h"),
        (F.sum("abroad") / n).alias("cross_border_ratio_30d"), (F.sum("exposed") / F.when(amount != 0, amount)).alias("high_risk_country_exposure"),
    )
    spine = account_universe(accounts, transactions, c.all_accounts).select("account_id").crossJoin(F.broadcast(date_spine(transactions, c)))
    parties = counterparties(counterparty_days(m), spine, bounds, c)
    out = spine.join(base, keys, "left").join(parties, keys, "left").join(dormant_days(daily, bounds, c), keys, "left")
    zero = {x: F.coalesce(F.col(x), F.lit(0).cast(t)) for x, t in out.dtypes if x not in (*keys, "dormant_days_before_activity")}
    out = out.withColumns(zero)
    sent, received = F.col("total_sent_7d").cast("double"), F.col("total_received_7d").cast("double")
    return out.withColumns({
        "feature_version": F.lit(c.version),
        "in_out_ratio_7d": F.when(received > 0, sent / received).when(sent > 0, RATIO_CAP).otherwise(0.0),
        "retained_balance_proxy": F.col("total_received_7d") - F.col("total_sent_7d"),
    })


def features_on(accounts: DataFrame, transactions: DataFrame, countries: DataFrame, date: str, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """The features of one date. Later transactions do not reach the shuffles, and of those before only what the date's windows and
    the last movement before them need."""
    upto = F.lit(date).cast("timestamp_ntz") + F.make_dt_interval(days=F.lit(1))
    so_far = transactions.filter(F.col("transaction_timestamp").cast("timestamp_ntz") <= upto)
    return account_features(accounts, so_far, countries, replace(config, min_date=date, max_date=date))


def dormant_days(daily: DataFrame, bounds: DataFrame, c: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Calendar days from the last movement before a date's daily window to the first inside it, from ``daily_sums``.

    Only dates with movement inside have a gap. The earlier movement is an as-of lookup by a running maximum over an
    account's active days, not over its history."""
    inside = _on_dates(daily.select("account_id", "first", "e"), bounds, c.daily).groupBy("account_id", "feature_date").agg(F.min("first").alias("first"))
    none = lambda t: F.lit(None).cast(t)
    marks = inside.select("account_id", F.date_sub("feature_date", c.daily + 1).alias("at"), "feature_date", "first", none("timestamp_ntz").alias("moved"))
    moves = daily.select("account_id", F.col("e").alias("at"), none("date").alias("feature_date"), none("timestamp_ntz").alias("first"), F.col("last").alias("moved"))
    prior = F.max("moved").over(Window.partitionBy("account_id").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    both = marks.unionByName(moves).withColumn("prior", prior).filter(F.col("feature_date").isNotNull())
    return both.select("account_id", "feature_date", F.datediff("first", "prior").alias("dormant_days_before_activity"))


def feature_summary(features: DataFrame) -> DataFrame:
    return features.agg(
        F.count("*").alias("row_count"), F.count_distinct("account_id").alias("account_count"), F.min("feature_date").alias("min_date"), F.max("feature_date").alias("max_date"),
        F.round(F.avg("txn_count_7d"), 6).alias("mean_txn_count_7d"), F.max("txn_count_7d").alias("max_txn_count_7d"), F.count(F.when(F.col("txn_count_7d") == 0, 1)).alias("zero_activity_rows"),
    )


#: The measures of the whole summary, and what it says of each beside the mean.
MEASURES = {
    "txn_count_7d": ("max",), "total_sent_7d": ("max",), "total_received_7d": ("max",), "unique_counterparties_7d": ("max",), "retained_balance_proxy": ("min", "max"), "below_threshold_count_24h": ("max",),
    "dormant_days_before_activity": ("max",), "cross_border_ratio_30d": ("max",), "high_risk_country_exposure": ("max",), "counterparty_entropy": ("max",),
}


def feature_measures(features: DataFrame) -> DataFrame:
    """One row: counts, dates and every measure's mean and extremes as doubles, 0 where there is no value. Measures that the
    table lacks are left out."""
    known = {c: fs for c, fs in MEASURES.items() if c in features.columns}
    double = lambda c: F.col(c).cast("double")
    made = [F.coalesce(getattr(F, f)(double(c)), F.lit(0.0)).alias(f"{f.replace('avg', 'mean')}_{c}") for c, fs in known.items() for f in ("avg", *fs)]
    return features.agg(
        F.count("*").alias("feature_row_count"), F.count_distinct("account_id").alias("account_count"), F.count_distinct("feature_version").alias("feature_version_count"),
        F.min("feature_date").alias("min_feature_date"), F.max("feature_date").alias("max_feature_date"), F.count_if(F.abs(double("in_out_ratio_7d")) == float("inf")).alias("infinite_in_out_ratio_count"),
        F.count_if(F.col("txn_count_7d") == 0).alias("zero_activity_row_count"), F.count("dormant_days_before_activity").alias("dormant_feature_non_null_count"), *made,
    )


def daily_totals(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    """Sent and received totals of every account over all time, zero-filled: both sides from one aggregate."""
    t = prepared(transactions)
    m = t.select(F.explode(F.array(F.struct(F.col("sender_account_id").alias("account_id"), F.lit(True).alias("out")), F.struct(F.col("receiver_account_id").alias("account_id"), F.lit(False).alias("out")))).alias("s"), "amount", "recipient_key").select("s.*", "amount", "recipient_key")
    out = F.col("out")
    sums = m.filter(F.col("account_id").isNotNull()).groupBy("account_id").agg(
        F.count(F.when(out, 1)).alias("sent_count"), F.count(F.when(~out, 1)).alias("received_count"), F.sum(F.when(out, F.col("amount"))).alias("total_sent"), F.sum(F.when(~out, F.col("amount"))).alias("total_received"),
        F.max(F.when(out, F.col("amount"))).alias("max_sent"), F.count_distinct(F.when(out, F.col("recipient_key"))).alias("unique_recipients"),
    )
    full = accounts.select("account_id").join(sums, "account_id", "left")
    return full.withColumns({x: F.coalesce(F.col(x), F.lit(0).cast(t)) for x, t in full.dtypes if x != "account_id"})
