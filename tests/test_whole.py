"""Graph queries over every transfer, against brute force."""

import inspect
from collections import defaultdict
from itertools import combinations

import pytest

from tallyhound.operators import graph, models, scoring
from tallyhound.plans import ALL_QUERIES
from tallyhound.sources import driver_tables as tables


@pytest.fixture(scope="module")
def pairs(spark, sf):
    """Sender and receiver of all transfers, straight from the tables."""
    n = max(r.c_custkey for r in tables.table(spark, sf, "customer").collect()) + 1
    orders = [r for r in tables.table(spark, sf, "orders").collect() if r.o_orderpriority.startswith("1")]
    return {(f"A{r.o_custkey}", f"A{(r.o_custkey * 7 + r.o_orderkey * 13) % n}") for r in orders}


def neighbours(pairs, both=False):
    out = defaultdict(set)
    for a, b in pairs:
        if a != b:
            out[a].add(b)
            out[b] |= {a} if both else set()
    return out


def brute_betweenness(pairs, size=None, most=None):
    """``size``: of the whole graph, where it has nodes without a link; ``most``: only so many sources."""
    near, nodes = neighbours(pairs), sorted({x for p in pairs if p[0] != p[1] for x in p})
    size = size or len(nodes)
    dist, paths = {}, {}
    for s in nodes:
        d, c, queue = {s: 0}, {s: 1}, [s]
        for v in queue:
            for w in near[v]:
                if w not in d:
                    d[w], c[w] = d[v] + 1, 0
                    queue.append(w)
                if d[w] == d[v] + 1:
                    c[w] += c[v]
        dist[s], paths[s] = d, c
    out = dict.fromkeys(nodes, 0.0)
    for s in nodes[:most]:
        for t in dist[s]:
            for v in dist[s]:
                if len({s, t, v}) == 3 and t in dist[v] and dist[s][v] + dist[v][t] == dist[s][t]:
                    out[v] += paths[s][v] * paths[v][t] / paths[s][t]
    return {v: b / ((size - 1) * (size - 2)) for v, b in out.items()}


def brute_modularity(pairs):
    """The best merge of all is looked for each time; of equal ones the last names count."""
    und = {tuple(sorted(p)) for p in pairs if p[0] != p[1]}
    group = {x: x for p in und for x in p}
    while True:
        between, weight = defaultdict(int), defaultdict(int)
        for a, b in und:
            weight[group[a]] += 1
            weight[group[b]] += 1
            if group[a] != group[b]:
                between[tuple(sorted((group[a], group[b])))] += 1
        gain, x, y = max(((2 * len(und) * e - weight[x] * weight[y], x, y) for (x, y), e in between.items()), default=(0, "", ""))
        if gain <= 0:
            return group
        group = {m: x if g == y else g for m, g in group.items()}


def test_betweenness_over_every_transfer(spark, sf, pairs):
    got = {r.account_id: r.betweenness_centrality for r in ALL_QUERIES["graph_betweenness"](spark, sf).collect()}
    assert got == pytest.approx(brute_betweenness(pairs))


def modularity(pairs, group):
    und = {tuple(sorted(p)) for p in pairs if p[0] != p[1]}
    inside, weight = defaultdict(int), defaultdict(int)
    for a, b in und:
        inside[group[a]] += group[a] == group[b]
        weight[group[a]] += 1
        weight[group[b]] += 1
    return sum(inside[g] / len(und) - (weight[g] / (2 * len(und))) ** 2 for g in weight)


def positive_merges(pairs, group):
    und = {tuple(sorted(p)) for p in pairs if p[0] != p[1]}
    between, weight = defaultdict(int), defaultdict(int)
    for a, b in und:
        weight[group[a]] += 1
        weight[group[b]] += 1
        between[frozenset((group[a], group[b]))] += group[a] != group[b]
    return [g for g, e in between.items() if len(g) == 2 and 2 * len(und) * e > weight[min(g)] * weight[max(g)]]


def test_modularity_over_every_transfer(spark, sf, pairs):
    """Merges of one round are chosen together, so groups differ from those of one merge at a time; their modularity hardly does, and no
    merge that would gain is left."""
    got = {r.account_id: r.community_id for r in ALL_QUERIES["graph_greedy_modularity"](spark, sf).collect()}
    want = brute_modularity(pairs)
    assert set(got) == set(want) and not positive_merges(pairs, got)
    assert modularity(pairs, got) > 0.95 * modularity(pairs, want) > 0
    first = {}
    for x in sorted(got):
        first.setdefault(got[x], x)
    assert list(first) == sorted(first) == list(range(1, len(first) + 1))  # numbered by their smallest account


def test_pagerank_over_every_transfer(spark, sf, pairs):
    got = {r.account_id: r.pagerank_score for r in ALL_QUERIES["graph_pagerank"](spark, sf).collect()}
    nodes, out = {x for p in pairs for x in p}, defaultdict(list)
    for a, b in pairs:
        out[a].append(b)
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(10):
        lost = sum(r for x, r in rank.items() if not out[x]) / len(nodes)
        new = dict.fromkeys(nodes, 0.15 / len(nodes) + 0.85 * lost)
        for a, to in out.items():
            for b in to:
                new[b] += 0.85 * rank[a] / len(to)
        rank = new
    assert got == pytest.approx(rank, abs=1e-9)


def test_clustering_over_every_transfer(spark, sf, pairs):
    got = {r.account_id: r.clustering_coefficient for r in ALL_QUERIES["graph_clustering"](spark, sf).collect()}
    near = neighbours(pairs, True)
    share = lambda v: sum(b in near[a] for a, b in combinations(sorted(v), 2)) / (len(v) * (len(v) - 1) / 2) if len(v) > 1 else 0.0
    assert any(got.values()) and got == {x: pytest.approx(share(near[x]), abs=1e-6) for x in got}


def test_communities_over_every_transfer(spark, sf, pairs):
    got = {r.account_id: (r.community_id, r.community_size) for r in ALL_QUERIES["graph_communities"](spark, sf).collect()}
    near, found = neighbours(pairs, True), []
    left = {x for p in pairs for x in p}
    while left:
        group = [left.pop()]
        for v in group:
            group += near[v] & left
            left -= near[v]
        found.append(group)
    assert got == {x: (k, len(g)) for k, g in enumerate(sorted(found, key=min), 1) for x in g}


def test_graph_features_are_of_the_projection(spark):
    """A -> B -> C -> D, and Q alone: customers, transactions and the alert are nodes, countries are without links."""
    accounts = spark.createDataFrame([(x, f"K{x}", "C1") for x in "ABCDQ"], "account_id string, customer_id string, home_country string")
    rows = [(f"T{a}", a, b, None, 5.0, "C1", "C1") for a, b in ("AB", "BC", "CD")]
    transactions = spark.createDataFrame(rows, "transaction_id string, sender_account_id string, receiver_account_id string, counterparty_id string, amount double, origin_country string, destination_country string")
    alerts = spark.createDataFrame([("L", "A", "high", ["TA"])], "alert_id string, account_id string, severity string, evidence_ids array<string>")
    pairs = {(f"K{x}", x) for x in "ABCDQ"} | {("L", "A"), ("L", "TA")} | {(a, f"T{a}") for a in "ABC"} | {(f"T{a}", b) for a, b in ("AB", "BC", "CD")}
    found = {r.account_id: r for r in graph.graph_features(accounts, transactions, alerts).collect()}
    want = brute_betweenness(pairs, 15)
    assert {x: r.betweenness_centrality for x, r in found.items()} == pytest.approx({x: want[x] for x in "ABCDQ"})
    assert {x: (r.degree, r.in_degree) for x, r in found.items()} == {"A": (3, 2), "B": (3, 2), "C": (3, 2), "D": (2, 2), "Q": (1, 1)}
    assert found["A"].degree_centrality == pytest.approx(3 / 14)
    assert {x: r.shortest_path_to_flagged for x, r in found.items()} == {"A": 1, "B": 2, "C": 4, "D": None, "Q": None}
    assert {x: (r.community_id, r.community_size, r.graph_component_size) for x, r in found.items()} == {"A": (1, 4, 12), "B": (1, 4, 12), "C": (1, 4, 12), "D": (1, 4, 12), "Q": (3, 1, 2)}
    assert found["A"].clustering_coefficient == pytest.approx(1 / 3)
    scores = {r.account_id: r.graph_risk_score for r in scoring.graph_component(accounts, graph.graph_features(accounts, transactions, alerts).select("account_id", "betweenness_centrality")).collect()}
    assert scores["B"] > scores["A"] > scores["D"] == scores["Q"]


def test_isolation_forest_query_has_all_trees(spark, sf, monkeypatch):
    real, seen = models.isolation_forest, []

    def spy(*args, **kwargs):
        bound = inspect.signature(real).bind(*args, **kwargs)
        bound.apply_defaults()
        seen.append(bound.arguments["trees"])
        return real(*args, **kwargs)

    monkeypatch.setattr(models, "isolation_forest", spy)
    assert ALL_QUERIES["model_isolation_forest"](spark, sf).count() > 0 and seen == [200]
