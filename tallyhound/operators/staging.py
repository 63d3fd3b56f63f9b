"""Raw records, staged tables and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhound.functions import normalise as n
from tallyhound.functions.analytic import latest_per_key
from tallyhound.functions.ids import record_hash

#: Columns of the staged tables and their keys.
TABLES = {
    "countries": ("country_code", ("country_code", "country_name", "region", "is_high_risk", "risk_score")),
    "customers": ("customer_id", ("customer_id", "customer_type", "customer_segment", "jurisdiction", "occupation", "industry_code", "customer_risk_rating", "customer_risk_score", "onboarded_at")),
    "accounts": ("account_id", ("account_id", "customer_id", "account_type", "account_status", "currency", "opened_at", "closed_at", "home_country")),
    "counterparties": ("counterparty_id", ("counterparty_id", "counterparty_type", "counterparty_name", "country_code", "institution_name", "external_account_ref", "risk_score")),
    "devices": ("device_id", ("device_id", "device_type", "ip_address", "ip_cluster", "phone_hash", "browser_fingerprint")),
    "transactions": ("transaction_id", ("transaction_id", "sender_account_id", "receiver_account_id", "counterparty_id", "device_id", "transaction_timestamp", "amount", "currency", "transaction_type", "channel", "origin_country", "destination_country", "is_cross_border", "is_labelled_suspicious", "typology_label", "source_file")),
}
LOAD_ORDER = ("countries", "customers", "accounts", "counterparties", "devices", "transactions")
PROMOTED = ("transaction_id", "sender_account_id", "receiver_account_id", "transaction_timestamp", "amount", "currency")


def raw_records(frame: DataFrame, system: str, file: str, table: str) -> DataFrame:
    """Key-sorted JSON payload with nulls kept, its SHA-256, lineage; of transactions six columns as well."""
    clean = n.missing_to_null(frame)
    payload = F.to_json(F.struct(*[F.col(c) for c in sorted(clean.columns)]), {"ignoreNullFields": "false"})
    kept = [F.col(c) for c in PROMOTED if table == "transactions" and c in clean.columns]
    return clean.select(F.lit(system).alias("source_system"), F.lit(file).alias("source_file_name"), F.lit(table).alias("table_name"), payload.alias("payload"), *kept).withColumn("record_hash", record_hash(F.col("payload")))


def expand_payload(raw: DataFrame, schema: str) -> DataFrame:
    """The payload's fields, and the lineage columns beside them; a clashing one is named raw_..."""
    fields = raw.select(F.from_json("payload", schema).alias("p")).select("p.*").columns
    lineage = [F.col(c).alias(f"raw_{c}" if c in fields else c) for c in raw.columns if c != "payload"]
    return raw.select(F.from_json("payload", schema).alias("p"), *lineage).select("p.*", *[c for c in [f"raw_{x}" if x in fields else x for x in raw.columns if x != "payload"]])


def keep_last(frame: DataFrame, key: str) -> DataFrame:
    """Of each key the row ingested last, by (ingested_at, raw_record_id) where they are there."""
    order = [F.desc_nulls_last(c) for c in ("ingested_at", "raw_record_id") if c in frame.columns] or [F.desc_nulls_last(c) for c in frame.columns if c != key]
    return latest_per_key(frame.filter(F.col(key).isNotNull()), [key], order)


def _staged(raw: DataFrame, table: str, exprs: dict[str, Column]) -> DataFrame:
    key, columns = TABLES[table]
    full = n.ensure_columns(raw, dict.fromkeys(columns, "string"))
    extra = [c for c in ("ingested_at", "raw_record_id") if c in raw.columns]
    made = full.select(*[exprs.get(c, n.text(F.col(c))).alias(c) for c in columns], *extra)
    return keep_last(made, key).select(*columns)


def countries(raw: DataFrame) -> DataFrame:
    return _staged(raw, "countries", {"country_code": n.country(F.col("country_code")), "is_high_risk": n.boolean(F.col("is_high_risk")), "risk_score": n.score(F.col("risk_score"))})


def customers(raw: DataFrame) -> DataFrame:
    return _staged(raw, "customers", {"customer_id": n.identifier(F.col("customer_id")), "jurisdiction": n.country(F.col("jurisdiction")), "customer_risk_rating": F.coalesce(F.lower(n.text(F.col("customer_risk_rating"))), F.lit("low")), "customer_risk_score": n.score(F.col("customer_risk_score")), "onboarded_at": n.timestamp(F.col("onboarded_at"))})


def accounts(raw: DataFrame) -> DataFrame:
    made = _staged(raw, "accounts", {
        "account_id": n.identifier(F.col("account_id")), "customer_id": n.identifier(F.col("customer_id")), "account_status": F.coalesce(F.lower(n.text(F.col("account_status"))), F.lit("active")),
        "currency": n.currency(F.col("currency")), "opened_at": n.timestamp(F.col("opened_at")), "closed_at": n.timestamp(F.col("closed_at")), "home_country": n.country(F.col("home_country")),
    })
    return made.filter(F.col("customer_id").isNotNull())


def counterparties(raw: DataFrame) -> DataFrame:
    return _staged(raw, "counterparties", {"counterparty_id": n.identifier(F.col("counterparty_id")), "country_code": n.country(F.col("country_code")), "risk_score": n.score(F.col("risk_score"))})


def devices(raw: DataFrame) -> DataFrame:
    return _staged(raw, "devices", {"device_id": n.identifier(F.col("device_id"))})


def transactions(raw: DataFrame) -> DataFrame:
    """Cross-border is computed anew (an unknown side is not); rows without id, sender, time or a positive amount go."""
    made = _staged(raw, "transactions", {
        **{c: n.identifier(F.col(c)) for c in ("transaction_id", "sender_account_id", "receiver_account_id", "counterparty_id", "device_id")},
        "transaction_timestamp": n.timestamp(F.col("transaction_timestamp")), "amount": n.number(F.col("amount"), kind="decimal(18,2)"), "currency": n.currency(F.col("currency")),
        "transaction_type": F.lower(n.text(F.col("transaction_type"))), "channel": F.lower(n.text(F.col("channel"))), "origin_country": n.country(F.col("origin_country")), "destination_country": n.country(F.col("destination_country")),
        "is_labelled_suspicious": n.boolean(F.col("is_labelled_suspicious")),
    })
    made = made.withColumn("is_cross_border", F.coalesce(F.col("origin_country") != F.col("destination_country"), F.lit(False)))
    return made.filter(F.col("sender_account_id").isNotNull() & F.col("transaction_timestamp").isNotNull() & (F.col("amount") > 0))


TRANSFORMS = {"countries": countries, "customers": customers, "accounts": accounts, "counterparties": counterparties, "devices": devices, "transactions": transactions}


def transform_all(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    unknown = set(raw) - set(TRANSFORMS)
    if unknown:
        raise ValueError(f"unknown tables {', '.join(sorted(unknown))}")
    return {t: TRANSFORMS[t](raw[t]) for t in LOAD_ORDER if t in raw}


def upsert(target: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace those with the same key, all others stay."""
    both = fresh.withColumn("_new", F.lit(1)).unionByName(target.withColumn("_new", F.lit(0)), allowMissingColumns=True)
    return latest_per_key(both, keys, [F.desc("_new")]).drop("_new")


def insert_missing(target: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is there already change nothing."""
    return target.unionByName(fresh.dropDuplicates(keys).join(target, keys, "left_anti").select(target.columns))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Values that name no parent, each once."""
    return child.filter(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().join(parent.select(F.col(key).alias("value")), "value", "left_anti")


def duplicates(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Every copy of rows that agree in ``columns``."""
    return frame.withColumn("_n", F.count("*").over(Window.partitionBy(*columns))).filter("_n > 1").drop("_n")


def integrity(tables: dict[str, DataFrame]) -> DataFrame:
    """check_name, violations: keys, references, amounts and the cross-border flag."""
    t = tables["transactions"]
    parts = {f"duplicate_{k}": duplicates(f, [TABLES[k][0]]) for k, f in tables.items()}
    refs = [("accounts", "customer_id", "customers", "customer_id"), ("transactions", "sender_account_id", "accounts", "account_id"), ("transactions", "receiver_account_id", "accounts", "account_id"), ("transactions", "counterparty_id", "counterparties", "counterparty_id")]
    parts |= {f"orphan_{a}_{c}": orphans(tables[a], c, tables[b], k) for a, c, b, k in refs if a in tables and b in tables}
    parts["amount_not_positive"] = t.filter(F.coalesce(F.col("amount") <= 0, F.lit(True)))
    if {"origin_country", "destination_country", "is_cross_border"} <= set(t.columns):
        parts["cross_border_flag"] = t.filter(F.col("is_cross_border") != F.coalesce(F.col("origin_country") != F.col("destination_country"), F.lit(False)))
    return reduce(DataFrame.unionByName, [f.agg(F.lit(k).alias("check_name"), F.count("*").alias("violations")) for k, f in parts.items()])


def run_staging(spark: SparkSession, raw: dict[str, DataFrame], out_dir: str) -> dict[str, str]:
    """Transforms every raw table and writes it in reference order; the paths by table."""
    paths = {}
    for name, frame in transform_all(raw).items():
        paths[name] = f"{out_dir}/{name}"
        frame.write.mode("overwrite").parquet(paths[name])
    return paths
