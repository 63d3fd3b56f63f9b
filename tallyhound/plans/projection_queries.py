"""Queries of graph features on the typed projection of the property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhound.checkpoints import checkpointed
from tallyhound.operators import graph, rules
from tallyhound.operators.projection import LABELS, RELATIONSHIPS
from tallyhound.plans.rule_queries import STRUCTURING
from tallyhound.plans.sql import CTES, compose
from tallyhound.sources import driver_tables as tables

QUERIES: dict = {}
SQL: dict[str, str] = {}
ROUNDS = 10
#: More than the widest shortest path of the test graph: where most accounts send to each other none is longer than ten.
SPREADS = 16


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = compose(sql)
        return f

    return add


def projection(spark, d, **chosen):
    """The projection of all event transactions, their accounts, countries and structuring alerts."""
    a, t = tables.event_accounts(spark, d), tables.event_transactions(spark, d)
    alerts = checkpointed(rules.structuring_alerts(t, a, STRUCTURING))
    return graph.projected_graph(a, t, alerts, tables.countries(spark, d), **chosen)


_TYPES = ", ".join(f"'{x}'" for x in RELATIONSHIPS)
CTES["pje"] = f"SELECT DISTINCT src, dst, type FROM {{e}} WHERE type IN ({_TYPES})"
CTES["pjn"] = """
SELECT row_number() OVER (ORDER BY id) AS node, id, label
FROM (SELECT id, max(label) AS label FROM (SELECT id, label FROM {v} UNION ALL SELECT src, NULL FROM {pje} UNION ALL SELECT dst, NULL FROM {pje}) GROUP BY id)"""
CTES["pjl"] = "SELECT a.node AS src, b.node AS dst, type FROM {pje} JOIN {pjn} a ON a.id = src JOIN {pjn} b ON b.id = dst"
CTES["pjs"] = "SELECT DISTINCT src, dst FROM {pjl}"
CTES["pjb"] = "SELECT src, dst FROM {pjs} UNION SELECT dst, src FROM {pjs}"
CTES["pja"] = "SELECT node, id AS account_id FROM {pjn} WHERE label = 'Account'"


@query("graph_projection_nodes", "SELECT node, id, label FROM {pjn}")
def _(spark, d):
    return projection(spark, d).nodes.select("node", "id", "label")


@query("graph_projection_links", "SELECT src, dst, type FROM {pjl}")
def _(spark, d):
    return projection(spark, d).links


CTES["pj2e"] = "SELECT DISTINCT src, dst, type FROM {e} WHERE type IN ('SENT', 'RECEIVED')"
CTES["pj2n"] = """
SELECT row_number() OVER (ORDER BY id) AS node, id, label
FROM (SELECT id, max(label) AS label FROM (SELECT id, label FROM {v} WHERE label IN ('Account', 'Customer', 'Country') UNION ALL SELECT src, NULL FROM {pj2e} UNION ALL SELECT dst, NULL FROM {pj2e}) GROUP BY id)"""


@query("graph_projection_chosen", "SELECT coalesce(label, '') AS label, count(*) AS nodes, sum(o) AS links FROM (SELECT n.node, n.label, count(e.src) AS o FROM {pj2n} n LEFT JOIN {pj2e} e ON e.src = n.id GROUP BY n.node, n.label) GROUP BY label")
def _(spark, d):
    p = projection(spark, d, relationships=("SENT", "RECEIVED"), labels=tuple(x for x in LABELS if x in ("Account", "Customer", "Country")))
    out = p.links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"))
    return p.nodes.join(out, "node", "left").groupBy(F.coalesce("label", F.lit("")).alias("label")).agg(F.count("*").alias("nodes"), F.coalesce(F.sum("o"), F.lit(0)).alias("links"))


CTES["pjd"] = "SELECT n, count(*) AS degree, sum(i) AS in_degree, sum(o) AS out_degree FROM (SELECT src AS n, 0 AS i, 1 AS o FROM {pjs} UNION ALL SELECT dst, 1, 0 FROM {pjs}) GROUP BY n"


@query("graph_projected_degrees", """
SELECT account_id, coalesce(degree, 0) AS degree, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree,
  round(coalesce(degree / m, 0), 9) AS degree_centrality, round(coalesce(in_degree / m, 0), 9) AS in_degree_centrality, round(coalesce(out_degree / m, 0), 9) AS out_degree_centrality
FROM {pja} LEFT JOIN {pjd} ON n = node, (SELECT count(*) - 1 AS m FROM {pjn})""")  # fmt: skip
def _(spark, d):
    p = projection(spark, d)
    found = p.named(graph.degrees(p.simple(), p.labelled("Account"), p.size))
    return found.withColumns({c: F.round(c, 9) for c in found.columns if c.endswith("centrality")})


CTES["pjo"] = "SELECT node, o, (SELECT count(*) FROM {pjn}) AS n FROM {pjn} LEFT JOIN (SELECT src, count(*) AS o FROM {pjs} GROUP BY src) ON src = node"
CTES["pjr0"] = "SELECT node, 1.0::DOUBLE / n AS r FROM {pjo}"
for _k in range(ROUNDS):
    CTES[f"pjr{_k + 1}"] = f"""
SELECT p.node, 0.15 / p.n + 0.85 * (coalesce(s.s, 0) + l.lost / p.n) AS r
FROM {{pjo}} p
  LEFT JOIN (SELECT g.dst, sum(q.r / o.o) AS s FROM {{pjs}} g JOIN {{pjr{_k}}} q ON g.src = q.node JOIN {{pjo}} o ON o.node = g.src GROUP BY g.dst) s ON s.dst = p.node,
  (SELECT coalesce(sum(q.r), 0) AS lost FROM {{pjr{_k}}} q JOIN {{pjo}} o ON o.node = q.node WHERE o.o IS NULL) l"""


@query("graph_projected_pagerank", f"SELECT account_id, round(r, 9) AS pagerank_score FROM {{pja}} JOIN {{pjr{ROUNDS}}} USING (node)")
def _(spark, d):
    p = projection(spark, d)
    ranks = graph.pagerank(p.simple(), rounds=ROUNDS, nodes=p.nodes.select(F.col("node").alias("id")))
    found = p.named(ranks.join(p.labelled("Account"), "account_id", "left_semi"))
    return found.withColumn("pagerank_score", F.round("pagerank_score", 9))


CTES["pjc0"] = "SELECT node, node AS root FROM {pjn}"
for _k in range(SPREADS):
    CTES[f"pjc{_k + 1}"] = f"SELECT c.node, least(c.root, coalesce(m.m, c.root)) AS root FROM {{pjc{_k}}} c LEFT JOIN (SELECT b.src, min(q.root) AS m FROM {{pjb}} b JOIN {{pjc{_k}}} q ON q.node = b.dst GROUP BY b.src) m ON m.src = c.node"
CTES["pjcg"] = f"SELECT root, count(*) AS graph_component_size, count(a.node) AS community_size, coalesce(min(a.node), min(c.node)) AS first FROM {{pjc{SPREADS}}} c LEFT JOIN {{pja}} a ON a.node = c.node GROUP BY root"


@query("graph_projected_communities", f"SELECT account_id, CAST(community_id AS INTEGER) AS community_id, community_size, graph_component_size FROM {{pja}} JOIN {{pjc{SPREADS}}} USING (node) JOIN (SELECT *, row_number() OVER (ORDER BY first) AS community_id FROM {{pjcg}}) USING (root)")
def _(spark, d):
    p = projection(spark, d)
    return p.named(graph.communities(p.simple(), p.labelled("Account"), p.nodes.select(F.col("node").alias("id"))))


CTES["pju"] = "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {pjs} WHERE src <> dst"
CTES["pjg"] = "SELECT n, count(*) AS d FROM (SELECT a AS n FROM {pju} UNION ALL SELECT b FROM {pju}) GROUP BY n"
CTES["pjt"] = "SELECT x.a, x.b, y.b AS c FROM {pju} x JOIN {pju} y ON x.b = y.a JOIN {pju} z ON z.a = x.a AND z.b = y.b"
CTES["pjtc"] = "SELECT n, count(*) AS t FROM (SELECT a AS n FROM {pjt} UNION ALL SELECT b FROM {pjt} UNION ALL SELECT c FROM {pjt}) GROUP BY n"


@query("graph_projected_clustering", """
SELECT account_id, round(CASE WHEN d > 1 THEN 2.0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END, 9) AS clustering_coefficient
FROM {pja} LEFT JOIN {pjg} g ON g.n = node LEFT JOIN {pjtc} c ON c.n = node""")  # fmt: skip
def _(spark, d):
    p = projection(spark, d)
    return p.named(graph.clustering(p.simple(), p.labelled("Account"))).withColumn("clustering_coefficient", F.round("clustering_coefficient", 9))


@query("graph_sampled_betweenness")
def _(spark, d):
    """From the first 200 nodes, the reference's own form for large graphs."""
    p = projection(spark, d)
    return p.named(graph.projected_betweenness(p, 200))


@query("graph_projected_modularity")
def _(spark, d):
    p = projection(spark, d)
    return p.named(graph.projected_modularity(p))
