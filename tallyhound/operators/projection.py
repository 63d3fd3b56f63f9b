"""A typed projection of the property graph, with numbers in place of ids.

Nodes are numbered 1..n in the order of their ids, once; iterations then join and shuffle 8-byte keys, and the smallest number of
a group is its smallest id. Names come back at the end.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.checkpoints import checkpointed
from tallyhound.functions.analytic import global_rank
from tallyhound.functions.joins import hot_keys, spread_join

#: What graph features are computed on, and which label counts for an id that has several.
RELATIONSHIPS = ("OWNS", "SENT", "RECEIVED", "PAID_TO", "FLAGS_ACCOUNT", "INVOLVES_TRANSACTION")
LABELS = ("Account", "Alert", "Transaction", "Counterparty", "Customer", "Country")


@dataclass(frozen=True)
class Projection:
    """nodes: node, id, label, severity; links: src, dst, type, by number."""

    nodes: DataFrame
    links: DataFrame
    size: int

    def simple(self) -> DataFrame:
        """Directed pairs; parallel relationships are one."""
        return self.links.select("src", "dst").repartition("src", "dst").distinct()

    def labelled(self, label: str, name: str = "account_id") -> DataFrame:
        return self.nodes.filter(F.col("label") == label).select(F.col("node").alias(name))

    def named(self, features: DataFrame, key: str = "account_id") -> DataFrame:
        """``features`` with ids in place of the numbers in ``key``."""
        return features.withColumnRenamed(key, "node").join(self.nodes.select("node", F.col("id").alias(key)), "node").select(key, *[c for c in features.columns if c != key])


def project(vertices: DataFrame, edges: DataFrame, relationships: Sequence[str] = RELATIONSHIPS, labels: Sequence[str] = LABELS) -> Projection:
    """vertices: id, label, severity; edges: src, dst, type. All vertices of the labels, linked or not, and the ends of
    all edges of the types; an end of no chosen label is a node without a label."""
    if not relationships or not labels:
        raise ValueError("a projection has relationships and labels")
    wanted = checkpointed(edges.filter(F.col("type").isin(*relationships)).select("src", "dst", "type").distinct())
    place = reduce(lambda out, x: out.when(F.col("label") == x[1], x[0]), enumerate(LABELS), F.when(F.lit(False), 0)).otherwise(len(LABELS))
    severity = F.col("severity") if "severity" in vertices.columns else F.lit(None).cast("string")
    known = vertices.filter(F.col("label").isin(*labels) & F.col("id").isNotNull()).select("id", F.struct(place.alias("place"), "label").alias("first"), severity.alias("severity"))
    # dealt by both ends first: no task makes a list of all ends in its part of the table, and an end of many links comes in shares
    both = F.array(F.struct(F.col("src").alias("id"), F.pmod(F.xxhash64("dst"), F.lit(64)).alias("share")), F.struct(F.col("dst").alias("id"), F.pmod(F.xxhash64("src"), F.lit(64)).alias("share")))
    ends = wanted.select(F.explode(both).alias("e")).select("e.*").repartition("id", "share").select("id").distinct().select("id", F.lit(None).cast(known.schema["first"].dataType).alias("first"), F.lit(None).cast("string").alias("severity"))
    nodes = known.unionByName(ends).repartition("id").groupBy("id").agg(F.min("first")["label"].alias("label"), F.max("severity").alias("severity"))
    nodes = checkpointed(global_rank(nodes, [F.asc("id")], "node").select(F.col("node").cast("long").alias("node"), "id", "label", "severity"))
    number = lambda links, end: spread_join(links, nodes.select(F.col("id").alias(end), F.col("node").alias(f"_{end}")), end, hot_keys(links, end))
    links = number(number(wanted, "src"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "type")
    return Projection(nodes, checkpointed(links), nodes.count())


def project_pairs(simple: DataFrame) -> Projection:
    """A plain graph of src, dst: every node is an account."""
    vertices = simple.select(F.explode(F.array("src", "dst")).alias("id"), F.lit("Account").alias("label")).distinct()
    return project(vertices, simple.select("src", "dst", F.lit("SENT").alias("type")), ("SENT",))
