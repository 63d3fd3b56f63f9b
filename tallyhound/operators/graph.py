"""Property graph and account graph features, all as distributed DataFrame operations.

vertices: id, label, severity; edges: src, dst, type. Iterations are bounded and cut their lineage with a
checkpoint in the folder the session names; nothing but counts and checksums comes to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.checkpoints import Scratch
from tallyhound.functions.analytic import global_rank
from tallyhound.functions.joins import hot_keys, spread_join
from tallyhound.operators import centrality, modularity
from tallyhound.operators.projection import Projection, project, project_pairs
from tallyhound.operators.rules import simple_cycles


def _node(label: str, key: str, severity: Column | None = None) -> list[Column]:
    return [F.col(key).alias("id"), F.lit(label).alias("label"), (severity if severity is not None else F.lit(None).cast("string")).alias("severity")]


def vertices(accounts: DataFrame, transactions: DataFrame, alerts: DataFrame | None = None, countries: DataFrame | None = None, counterparties: DataFrame | None = None) -> DataFrame:
    """One row an id and label; explicit records come before inferred ones, null ids are dropped."""
    parts = [
        accounts.select(*_node("Customer", "customer_id"), F.lit(0).alias("p")), accounts.select(*_node("Account", "account_id"), F.lit(0).alias("p")),
        transactions.select(*_node("Transaction", "transaction_id"), F.lit(0).alias("p")), transactions.select(*_node("Counterparty", "counterparty_id"), F.lit(1).alias("p")).distinct(),
        transactions.select(*_node("Country", "origin_country"), F.lit(1).alias("p")).distinct(), transactions.select(*_node("Country", "destination_country"), F.lit(1).alias("p")).distinct(),
    ]
    if counterparties is not None:
        parts.append(counterparties.select(*_node("Counterparty", "counterparty_id"), F.lit(0).alias("p")))
    if countries is not None:
        parts.append(countries.select(*_node("Country", "country_code"), F.lit(0).alias("p")))
    if alerts is not None:
        parts.append(alerts.select(*_node("Alert", "alert_id", F.col("severity")), F.lit(0).alias("p")))
    every = reduce(DataFrame.unionByName, parts).filter(F.col("id").isNotNull())
    # dealt by id before anything is grouped: most ids are there once, and a task would group all of its part of the table in vain
    return every.repartition("id", "label").groupBy("id", "label").agg(F.max("severity").alias("severity"), (F.min("p") == 0).alias("explicit"))


def edges(accounts: DataFrame, transactions: DataFrame, alerts: DataFrame | None = None, customers: DataFrame | None = None, counterparties: DataFrame | None = None) -> DataFrame:
    """The eight relationship types, distinct, both ends present. A transaction is located in one country, its destination
    if it has one, else its origin; a customer in its jurisdiction."""
    e = lambda frame, kind, src, dst: frame.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("type"))
    parts = [
        e(accounts, "OWNS", "customer_id", "account_id"), e(transactions, "SENT", "sender_account_id", "transaction_id"), e(transactions, "RECEIVED", "transaction_id", "receiver_account_id"),
        e(transactions, "PAID_TO", "transaction_id", "counterparty_id"), e(accounts, "LOCATED_IN", "account_id", "home_country"),
        e(transactions.withColumn("_country", F.coalesce("destination_country", "origin_country")), "LOCATED_IN", "transaction_id", "_country"),
    ]
    if customers is not None:
        parts.append(e(customers, "LOCATED_IN", "customer_id", "jurisdiction"))
    if counterparties is not None:
        parts.append(e(counterparties, "LOCATED_IN", "counterparty_id", "country_code"))
    if alerts is not None:
        parts += [e(alerts, "FLAGS_ACCOUNT", "alert_id", "account_id"), e(alerts.select("alert_id", F.explode("evidence_ids").alias("tx")), "INVOLVES_TRANSACTION", "alert_id", "tx"), e(alerts, "TRIGGERS", "account_id", "alert_id")]
    return reduce(DataFrame.unionByName, parts).filter(F.col("src").isNotNull() & F.col("dst").isNotNull()).repartition("src", "dst", "type").distinct()


def matched_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges whose two ends exist."""
    ids = vertices.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "type")


def reconcile(vertices: DataFrame, edges: DataFrame, loaded_vertices: DataFrame, loaded_edges: DataFrame) -> DataFrame:
    """kind, name, expected, actual, matches."""
    count = lambda f, kind, by: f.groupBy(F.lit(kind).alias("kind"), F.col(by).alias("name")).agg(F.count("*").alias("n"))
    want = count(vertices, "node", "label").unionByName(count(edges, "edge", "type")).withColumnRenamed("n", "expected")
    have = count(loaded_vertices, "node", "label").unionByName(count(loaded_edges, "edge", "type")).withColumnRenamed("n", "actual")
    both = want.join(have, ["kind", "name"], "full").fillna(0, ["expected", "actual"])
    return both.withColumn("matches", F.col("expected") == F.col("actual"))


def flow_edges(transactions: DataFrame) -> DataFrame:
    """Account flow graph: one edge a source and target, its value and transactions."""
    sides = F.explode(F.array_compact(F.array(
        F.when(F.col("receiver_account_id").isNotNull(), F.struct(F.col("receiver_account_id").alias("dst"), F.lit("Account").alias("dst_label"))),
        F.when(F.col("counterparty_id").isNotNull(), F.struct(F.col("counterparty_id").alias("dst"), F.lit("Counterparty").alias("dst_label"))),
    )))
    t = transactions.filter(F.col("sender_account_id").isNotNull()).select(F.col("sender_account_id").alias("src"), sides.alias("s"), "amount").select("src", "s.*", "amount")
    return t.repartition("src", "dst", "dst_label").groupBy("src", "dst", "dst_label").agg(F.sum("amount").alias("amount"), F.count("*").alias("transaction_count"))


def flow_features(flow: DataFrame, accounts: DataFrame) -> DataFrame:
    """Fan-in and fan-out, neighbours, counterparties and totals: one aggregate over both ends of each edge."""
    ends = flow.select(F.explode(F.array(
        F.struct(F.col("src").alias("account_id"), F.col("dst").alias("other"), F.col("dst_label").alias("label"), F.lit(True).alias("out")),
        F.struct(F.col("dst").alias("account_id"), F.col("src").alias("other"), F.lit("Account").alias("label"), F.lit(False).alias("out")),
    )).alias("e"), "amount").select("e.*", "amount")
    out = F.col("out")
    agg = ends.groupBy("account_id").agg(
        F.count_distinct(F.when(~out, F.col("other"))).alias("fan_in_count"), F.count_distinct(F.when(out, F.col("other"))).alias("fan_out_count"), F.count_distinct(F.when(F.col("label") == "Account", F.col("other"))).alias("neighbour_account_count"),
        F.count_distinct(F.when(out & (F.col("label") == "Counterparty"), F.col("other"))).alias("counterparty_count"), F.sum(F.when(out, F.col("amount"))).alias("total_sent_amount"), F.sum(F.when(~out, F.col("amount"))).alias("total_received_amount"),
    )
    return zero_filled(accounts, agg)


def zero_filled(accounts: DataFrame, features: DataFrame, keep_null: tuple[str, ...] = ()) -> DataFrame:
    full = accounts.select("account_id").join(features, "account_id", "left")
    return full.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(t)) for c, t in full.dtypes if c != "account_id" and c not in keep_null})


def degrees(simple: DataFrame, accounts: DataFrame, size: int | None = None) -> DataFrame:
    """simple: distinct src, dst. Centralities are degrees over n - 1, n being ``size`` or the nodes of the pairs."""
    ends = simple.select(F.explode(F.array(F.struct(F.col("src").alias("account_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("account_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    d = ends.groupBy("account_id").agg(F.count("*").alias("degree"), F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    n = F.broadcast(d.agg(F.greatest((F.lit(size) if size else F.count("*")) - 1, F.lit(1)).alias("_n")))
    d = d.crossJoin(n).withColumns({f"{x}_centrality": F.col(x) / F.col("_n") for x in ("degree", "in_degree", "out_degree")}).drop("_n")
    return zero_filled(accounts, d)


def pagerank(simple: DataFrame, alpha: float = 0.85, rounds: int | None = None, tolerance: float = 1e-6, most_rounds: int = 100, nodes: DataFrame | None = None) -> DataFrame:
    """account_id, pagerank_score after ``rounds`` rounds, or, by default, once all scores together move by less than
    ``tolerance`` a node (an error after ``most_rounds``); dangling mass is shared evenly. ``nodes``: id, where there are more nodes than
    the pairs have.

    A round is one join of the links, one sum by target, and one join of the nodes."""
    with Scratch() as keep:
        out = simple.groupBy("src").agg(F.count("*").alias("out"))
        hot = hot_keys(simple, "src")
        links = keep(spread_join(simple, out, "src", hot))
        ends = simple.select(F.explode(F.array("src", "dst")).alias("id"))
        every = (ends if nodes is None else ends.unionByName(nodes.select("id"))).distinct()
        every = keep(every.join(out.withColumnRenamed("src", "id"), "id", "left"))
        n = every.count()
        if n == 0:
            return keep.result(every.select(F.col("id").alias("account_id"), F.lit(0.0).alias("pagerank_score")))
        rank = keep(every.select("id", "out", F.lit(1.0 / n).alias("r")))
        for turn in range(rounds or most_rounds):
            before = rank
            sums = spread_join(links, rank.select(F.col("id").alias("src"), "r"), "src", hot).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("r") / F.col("out")).alias("s"))
            lost = F.broadcast(rank.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("r"))), F.lit(0.0)).alias("lost")))
            # ranks are read twice a round, for the sums and for the lost mass, so each round is written
            rank = keep(every.join(sums, "id", "left").crossJoin(lost).select("id", "out", ((1 - alpha) / n + alpha * (F.coalesce("s", F.lit(0.0)) + F.col("lost") / n)).alias("r")))
            if rounds is None:
                moved = rank.join(before.select("id", F.col("r").alias("b")), "id").agg(F.sum(F.abs(F.col("r") - F.col("b")))).first()[0]
                if moved < n * tolerance:
                    break
            keep.forget(before)
        else:
            if rounds is None:
                raise ValueError(f"scores still move after {most_rounds} rounds")
        return keep.result(rank.select(F.col("id").alias("account_id"), F.col("r").alias("pagerank_score")))


def component_roots(simple: DataFrame) -> DataFrame:
    """id, root: the smallest id of each weakly connected component, by min-label spreading with shortcuts."""
    with Scratch() as keep:
        both = keep(simple.select("src", "dst").unionByName(simple.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
        hot = hot_keys(both, "dst")
        label = keep(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("root")))
        before = None
        while True:
            near = spread_join(both, label.select(F.col("id").alias("dst"), "root"), "dst", hot).groupBy(F.col("src").alias("id")).agg(F.min("root").alias("m"))
            step = keep(label.join(near, "id").select("id", F.least("root", "m").alias("root")))
            jump = step.select(F.col("id").alias("root"), F.col("root").alias("up"))
            old, label = label, keep(spread_join(step, jump, "root", hot_keys(step, "root")).select("id", F.least("root", "up").alias("root")))
            now = tuple(label.agg(F.count("*"), F.bit_xor(F.xxhash64("id", "root"))).first())
            if now == before:
                return keep.result(label)
            keep.forget(old, step)
            before = now


def communities(simple: DataFrame, accounts: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Connected components as communities; with ``nodes`` (id), those without a link are communities of their own."""
    roots = component_roots(simple)
    if nodes is not None:
        roots = nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    return numbered_communities(roots, accounts)


def numbered_communities(roots: DataFrame, accounts: DataFrame) -> DataFrame:
    """roots: id, root. Communities numbered by order of their smallest account, with their size in accounts and in all nodes."""
    named = roots.join(accounts.select(F.col("account_id").alias("id"), F.lit(1).alias("is_account")), "id", "left")
    per = named.groupBy("root").agg(F.count("*").alias("graph_component_size"), F.count("is_account").alias("community_size"), F.coalesce(F.min(F.when(F.col("is_account") == 1, F.col("id"))), F.min("id")).alias("first"))
    per = global_rank(per, [F.asc("first")], "community_id").withColumn("community_id", F.col("community_id").cast("int"))
    return named.filter("is_account = 1").join(per, "root").select(F.col("id").alias("account_id"), "community_id", "community_size", "graph_component_size")


def clustering(simple: DataFrame, accounts: DataFrame) -> DataFrame:
    """Share of an account's neighbour pairs that are linked. Edges are oriented from lower to higher degree,
    so a hub starts no long list of pairs and each triangle is found once."""
    und = simple.filter(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    deg = und.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    e = und.join(deg.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    x, y = F.struct(F.col("da").alias("d"), F.col("a").alias("n")), F.struct(F.col("db").alias("d"), F.col("b").alias("n"))
    o = e.select(F.least(x, y)["n"].alias("u"), F.greatest(x, y)["n"].alias("v"))
    wedges = o.join(o.select("u", F.col("v").alias("w")), "u").filter(F.col("v") < F.col("w"))
    triangles = wedges.join(und, (wedges["v"] == und["a"]) & (wedges["w"] == und["b"]), "left_semi")
    t = triangles.select(F.explode(F.array("u", "v", "w")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    c = deg.join(t, "id", "left").select(F.col("id").alias("account_id"), F.when(F.col("d") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("clustering_coefficient"))
    return zero_filled(accounts, c)


def cycle_counts(simple: DataFrame, accounts: DataFrame, max_hops: int = 4) -> DataFrame:
    """Simple directed cycles of 2 to ``max_hops`` accounts that an account lies on; all are counted."""
    plain = simple.filter(F.col("src") != F.col("dst")).select(F.col("src").alias("source"), F.col("dst").alias("target")).distinct()
    found = simple_cycles(plain, 2, max_hops).select(F.explode("accounts").alias("account_id")).groupBy("account_id").agg(F.count("*").alias("cycle_count"))
    return zero_filled(accounts, found)


def alert_proximity(edges: DataFrame, alerts: DataFrame, accounts: DataFrame, depth: int = 4, severe: tuple[str, ...] = ("high", "critical")) -> DataFrame:
    """Adjacent alerts, and hops to the nearest severe one: one search outwards from all severe alerts at once."""
    with Scratch() as keep:
        both = keep(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())  # every hop joins it
        hot = hot_keys(both, "src")
        a = keep(alerts.select(F.col("alert_id").alias("dst"), F.lower("severity").isin(*severe).alias("severe")).dropDuplicates(["dst"]))
        adjacent = both.join(a, "dst").groupBy(F.col("src").alias("account_id")).agg(F.count("*").alias("alert_count"), F.count(F.when(F.col("severe"), 1)).alias("high_risk_alert_count"))
        seen = a.filter("severe").select(F.col("dst").alias("id"), F.lit(0).alias("hops"))
        frontier = seen
        for k in range(1, depth + 1):
            reached = spread_join(both, frontier.select(F.col("id").alias("src")), "src", hot).select(F.col("dst").alias("id")).distinct()
            frontier = keep(reached.join(seen, "id", "left_anti").withColumn("hops", F.lit(k)))
            seen = seen.unionByName(frontier)
        hops = seen.select(F.col("id").alias("account_id"), F.col("hops").alias("shortest_path_to_flagged"))
        return keep.result(zero_filled(accounts, adjacent.join(hops, "account_id", "full"), ("shortest_path_to_flagged",)))


def neighbourhood(edges: DataFrame, start: str, hops: int = 2) -> DataFrame:
    """id, hops of everything within ``hops`` of one node."""
    if not 1 <= hops <= 5:
        raise ValueError("from 1 to 5 hops")
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = edges.sparkSession.range(1).select(F.lit(start).alias("id"), F.lit(0).alias("hops"))
    frontier = seen
    for k in range(1, hops + 1):
        frontier = both.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(k))
        seen = seen.unionByName(frontier)
    return seen


def betweenness(simple: DataFrame, most_sources: int | None = None) -> DataFrame:
    """account_id, betweenness_centrality of a plain graph of src, dst, normalised for a directed graph."""
    p = project_pairs(simple.filter(F.col("src") != F.col("dst")))
    return p.named(projected_betweenness(p, most_sources))


def projected_betweenness(p: Projection, most_sources: int | None = None) -> DataFrame:
    found = centrality.betweenness(p.simple(), p.size, most_sources).withColumnRenamed("node", "account_id")
    return zero_filled(p.labelled("Account"), found)


def greedy_modularity(simple: DataFrame) -> DataFrame:
    """account_id, community_id of a plain graph of src, dst."""
    p = project_pairs(simple.filter(F.col("src") != F.col("dst")))
    return p.named(projected_modularity(p).select("account_id", "community_id"))


def projected_modularity(p: Projection) -> DataFrame:
    found = modularity.modularity_communities(p.simple())
    roots = p.nodes.select("node").join(found, "node", "left").select(F.col("node").alias("id"), F.coalesce("community", "node").alias("root"))
    return numbered_communities(roots, p.labelled("Account"))


def merged(accounts: DataFrame, frames: list[DataFrame]) -> DataFrame:
    """Left joins by account; of a column that several frames have, a later value wins if it isn't null."""
    out = accounts.select("account_id")
    for k, frame in enumerate(frames):
        clash = [c for c in frame.columns if c in out.columns and c != "account_id"]
        renamed = frame.withColumnsRenamed({c: f"_{k}_{c}" for c in clash})
        out = out.join(renamed, "account_id", "left").withColumns({c: F.coalesce(f"_{k}_{c}", c) for c in clash}).drop(*[f"_{k}_{c}" for c in clash])
    return out


def projected_graph(accounts: DataFrame, transactions: DataFrame, alerts: DataFrame, countries: DataFrame | None = None, counterparties: DataFrame | None = None, **chosen) -> Projection:
    """The projection that graph features are computed on; ``chosen``: relationships or labels."""
    return project(vertices(accounts, transactions, alerts, countries, counterparties), edges(accounts, transactions, alerts), **chosen)


def projected_features(p: Projection, most_sources: int | None = None, community: str = "connected_components", exact_betweenness: bool = True) -> DataFrame:
    """By node number: degrees, PageRank, betweenness, communities, clustering and proximity on the projection."""
    if community not in ("connected_components", "greedy_modularity"):
        raise ValueError(f"no communities by {community}")
    simple, accounts, nodes = p.simple(), p.labelled("Account"), p.nodes.select(F.col("node").alias("id"))
    alerts = p.nodes.filter("label = 'Alert'").select(F.col("node").alias("alert_id"), "severity")
    groups = communities(simple, accounts, nodes) if community == "connected_components" else projected_modularity(p)
    frames = [degrees(simple, accounts, p.size), zero_filled(accounts, pagerank(simple, nodes=nodes)), groups, clustering(simple, accounts), alert_proximity(simple, alerts, accounts)]
    if exact_betweenness:
        frames.append(projected_betweenness(p, most_sources))
    return merged(accounts, frames)


def graph_features(
    accounts: DataFrame, transactions: DataFrame, alerts: DataFrame, exact_betweenness: bool = True, most_sources: int | None = None, countries: DataFrame | None = None,
    counterparties: DataFrame | None = None, community: str = "connected_components",
) -> DataFrame:
    """All account graph features. Cycles and flow are those of the account flow graph; all others are computed on the projection of
    accounts, customers, transactions, counterparties and alerts. Betweenness is exact; ``most_sources`` bounds its sources."""
    p = projected_graph(accounts, transactions, alerts, countries, counterparties)
    flow = flow_edges(transactions)
    simple = flow.filter("dst_label = 'Account'").select("src", "dst").distinct()
    return merged(accounts, [p.named(projected_features(p, most_sources, community, exact_betweenness)), cycle_counts(simple, accounts), flow_features(flow, accounts)])
