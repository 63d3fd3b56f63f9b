"""The typed projection, betweenness and modularity by joins, and joins of hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from tallyhound import checkpoints
from tallyhound.functions import joins
from tallyhound.operators import centrality, graph
from tallyhound.operators.modularity import modularity_communities
from tallyhound.operators.projection import project, project_pairs
from tallyhound.plans import ALL_QUERIES
from tallyhound.plans.projection_queries import projection
from test_whole import brute_betweenness, brute_modularity, modularity, positive_merges

V, E = "id string, label string, severity string", "src string, dst string, type string"


def pairs_frame(spark, pairs):
    return spark.createDataFrame(sorted(pairs), "src string, dst string")


def random_pairs(seed, nodes, edges, hub=False):
    rng = random.Random(seed)
    found = {(f"n{rng.randrange(nodes):03}", f"n{rng.randrange(nodes):03}") for _ in range(edges)}
    return found | ({("n000", f"n{k:03}") for k in range(nodes)} if hub else set())


def test_projection_of_labels_and_types(spark):
    v = spark.createDataFrame([("b", "Account", None), ("a", "Customer", None), ("z", "Alert", "high"), ("z", "Account", None), ("k", "Country", None), ("t", "Transaction", None), (None, "Account", None)], V)
    e = spark.createDataFrame([("a", "b", "OWNS"), ("a", "b", "OWNS"), ("b", "t", "SENT"), ("b", "k", "LOCATED_IN"), ("z", "b", "FLAGS_ACCOUNT"), ("t", "new", "RECEIVED")], E)
    p = project(v, e)
    assert [tuple(r) for r in p.nodes.orderBy("node").collect()] == [(1, "a", "Customer", None), (2, "b", "Account", None), (3, "k", "Country", None), (4, "new", None, None), (5, "t", "Transaction", None), (6, "z", "Account", "high")]
    assert p.size == 6 and sorted(tuple(r) for r in p.links.collect()) == [(1, 2, "OWNS"), (2, 5, "SENT"), (5, 4, "RECEIVED"), (6, 2, "FLAGS_ACCOUNT")]
    few = project(v, e, ["SENT"], ["Account"])
    assert [tuple(r) for r in few.nodes.orderBy("node").collect()] == [(1, "b", "Account", None), (2, "t", None, None), (3, "z", "Account", None)]
    with pytest.raises(ValueError, match="has relationships"):
        project(v, e, [])


@pytest.mark.parametrize("seed,nodes,edges,hub,at_once,small", [(1, 25, 40, True, 50_000_000, 1_000_000), (2, 24, 40, True, 300, 0)])
def test_betweenness_in_batches(spark, monkeypatch, seed, nodes, edges, hub, at_once, small):
    monkeypatch.setattr(centrality, "SMALL_LINKS", small)
    pairs = random_pairs(seed, nodes, edges, hub)
    p = project_pairs(pairs_frame(spark, {x for x in pairs if x[0] != x[1]}))
    found = centrality.betweenness(p.simple(), p.size, pairs_at_once=at_once, slices=3)
    got = {r.id: r.betweenness_centrality for r in found.join(p.nodes, "node").collect()}
    want = brute_betweenness(pairs)
    assert {x: got.get(x, 0.0) for x in want} == pytest.approx(want)
    some = {r.id: r.betweenness_centrality for r in centrality.betweenness(p.simple(), p.size, 4, at_once).join(p.nodes, "node").collect()}
    want = brute_betweenness(pairs, most=4)
    assert {x: some.get(x, 0.0) for x in want} == pytest.approx(want)


def test_sampled_betweenness_of_the_projection(spark, sf):
    p = projection(spark, sf)
    names = dict(p.nodes.select("node", "id").collect())
    pairs = {(names[r.src], names[r.dst]) for r in p.links.collect()}
    everyone = sorted(names.values())
    got = {r.account_id: r.betweenness_centrality for r in ALL_QUERIES["graph_sampled_betweenness"](spark, sf).collect()}
    linked = {x for q in pairs for x in q}
    few = sum(x in linked for x in everyone[:200])  # nodes without a link are sources too, of nothing
    want = brute_betweenness_of(pairs, sorted(linked)[:few], len(everyone))
    assert any(got.values()) and got == pytest.approx({x: want.get(x, 0.0) for x in got})


def brute_betweenness_of(pairs, sources, size):
    """One source at a time, dependencies by the textbook."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    out = {}
    for s in sources:
        dist, paths, before, order = {s: 0}, {s: 1}, {}, [s]
        for v in order:
            for w in near.get(v, ()):
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before.setdefault(w, []).append(v)
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before.get(w, ()):
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                out[w] = out.get(w, 0.0) + share[w]
    return {v: b / ((size - 1) * (size - 2)) for v, b in out.items()}


@pytest.mark.parametrize("seed,nodes,edges,hub", [(1, 30, 45, True)])
def test_modularity_in_rounds(spark, seed, nodes, edges, hub):
    pairs = {x for x in random_pairs(seed, nodes, edges, hub) if x[0] != x[1]}
    p = project_pairs(pairs_frame(spark, pairs))
    runs = [{r.id: r.community for r in modularity_communities(p.simple().repartition(k)).join(p.nodes, "node").collect()} for k in (1, 7)]
    assert runs[0] == runs[1] and not positive_merges(pairs, runs[0])
    assert modularity(pairs, runs[0]) >= 0.9 * modularity(pairs, brute_modularity(pairs))


def test_a_star_is_one_community_in_few_rounds(spark, monkeypatch):
    rounds = []
    real = checkpoints.Scratch.forget
    monkeypatch.setattr(checkpoints.Scratch, "forget", lambda self, *f: (rounds.append(1), real(self, *f))[1])
    star = spark.range(1, 301).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    assert {r.community for r in modularity_communities(star).collect()} == {0} and len(rounds) < 6


def test_communities_of_a_projection_by_modularity(spark):
    clique = lambda x: {(f"{x}{i}", f"{x}{j}") for i in range(4) for j in range(i)}
    accounts = spark.createDataFrame([(f"{x}{i}", f"K{x}", "C1") for x in "ab" for i in range(4)], "account_id string, customer_id string, home_country string")
    rows = [(f"T{k}", a, b, None, 5.0, "C1", "C1") for k, (a, b) in enumerate(sorted(clique("a") | clique("b") | {("a0", "b0")}))]
    t = spark.createDataFrame(rows, "transaction_id string, sender_account_id string, receiver_account_id string, counterparty_id string, amount double, origin_country string, destination_country string")
    alerts = spark.createDataFrame([], "alert_id string, account_id string, severity string, evidence_ids array<string>")
    found = graph.graph_features(accounts, t, alerts, exact_betweenness=False, community="greedy_modularity").collect()
    groups = {r.account_id: r.community_id for r in found}
    assert len(groups) == 8 and 1 < len(set(groups.values())) < 8 and groups["a1"] != groups["b1"]
    with pytest.raises(ValueError, match="no communities by"):
        graph.graph_features(accounts, t, alerts, community="other")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join(spark, monkeypatch, how):
    facts = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("x"))
    one = spark.range(0, 60, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y")).union(spark.sql("SELECT 7L, -1L"))
    hot = joins.hot_keys(facts, "k", least=500)
    assert [r.k for r in hot.collect()] == [7] and joins.hot_keys(facts, "k") is None and joins.hot_keys(facts, "k", rows=5) is None
    rows = lambda f: sorted(map(tuple, f.select("k", "x", "y").collect()), key=repr)
    assert rows(joins.spread_join(facts, one, "k", hot, how)) == rows(facts.join(one, "k", how))


def test_scratch_leaves_only_its_result(spark):
    before = len(checkpoints._PATHS)
    with checkpoints.Scratch() as keep:
        a = keep(spark.range(5))
        b = keep(a.filter("id > 2"))
        keep.forget(a)
        out = keep.result(b)
    assert out.count() == 2 and len(checkpoints._PATHS) == before + 1


def test_a_long_table_with_small_files_is_not_broadcast(spark):
    numbers = lambda n: checkpoints.checkpointed(spark.range(n).select(F.col("id").alias("node")))
    plan = lambda a, b: a.join(b, "node", "left")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(numbers(300_000), numbers(200_000)) and "BroadcastHashJoin" in plan(numbers(300), numbers(200))


def test_hot_keys_by_hash_are_those_by_key(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.col("id") % 6).otherwise(F.col("id")).alias("k"))
    assert sorted(r.k for r in joins.hot_keys(rows, "k", least=100).collect()) == [0, 2, 4]
    assert joins.hot_keys(rows.filter("k > 6"), "k", least=100) is None


def test_distinct_links_are_dealt_before_they_are_grouped(spark):
    """A task that groups its part of the table before the shuffle holds as much as that part, as hardly any link is there twice."""
    from tallyhound.sources import driver_tables

    t, a = driver_tables.event_transactions(spark, "/root/testdata/sf0.001"), driver_tables.event_accounts(spark, "/root/testdata/sf0.001")
    tree = graph.edges(a, t)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in tree and "ENSURE_REQUIREMENTS" not in tree.split("REPARTITION_BY_COL")[0]


def test_levels_broadcast_no_links(spark):
    from tallyhound.checkpoints import checkpointed
    from tallyhound.operators import centrality

    links = checkpointed(spark.range(150_000).selectExpr("id AS src", "id + 1 AS dst"))
    rows = spark.range(3).selectExpr("1L AS s", "id AS src")
    plan = lambda hot: centrality._step(rows, links, "src", "dst", hot)
    assert "Broadcast" not in plan(None)._jdf.queryExecution().executedPlan().toString()
    hot = spark.range(2).selectExpr("id AS src")
    assert {tuple(r) for r in plan(hot).select("s", "src", "dst").collect()} == {(1, k, k + 1) for k in range(3)}


@pytest.mark.parametrize("local", [0, 10**6])
def test_betweenness_in_tasks_and_by_joins(spark, monkeypatch, local):
    pairs = {(f"n{a:03d}", f"n{b:03d}") for a, b in [(k, (k * 7 + j * 3) % 40) for k in range(40) for j in range(k % 3)]} | {("n040", f"n{k:03d}") for k in range(30)}
    pairs = {x for x in pairs if x[0] != x[1]}
    p = project_pairs(pairs_frame(spark, pairs))
    joined = []
    monkeypatch.setattr(centrality, "_step", lambda *a, f=centrality._step: joined.append(1) or f(*a))
    monkeypatch.setattr(centrality, "LOCAL_LINKS", local)
    monkeypatch.setattr(centrality, "LOCAL_STEP", 7)
    got = {r.id: r.betweenness_centrality for r in centrality.betweenness(p.simple(), p.size).join(p.nodes, "node").collect()}
    want = brute_betweenness(pairs)
    assert {x: got.get(x, 0.0) for x in want} == pytest.approx(want) and bool(joined) == (not local)
