"""The whole run over the small test tables."""

from collections import defaultdict

import pytest

from tallyhound.operators.scoring import SEVERITY
from tallyhound.plans import run_queries, service
from tallyhound.plans.rule_queries import CONFIGS


def test_run(spark, sf, tmp_path):
    staged = run_queries.staged(spark, sf)
    config = service.ServiceConfig(rule_configs=CONFIGS, anomaly_trees=20)
    out = service.run(spark, staged, str(tmp_path), config, "run")
    rows = {r.table_name: r.rows for r in service.audit(out, "run").collect()}
    n = staged["accounts"].count()
    assert rows["account_risk_scores"] == rows["graph_features"] == rows["account_anomaly_scores"] == n
    assert rows["alerts"] > 0 and rows["cases"] == rows["case_risk_scores"] == rows["case_evidence_packs"] > 0
    ranks = sorted(r.risk_rank for r in out["account_risk_scores"].collect())
    assert ranks == list(range(1, n + 1))
    pack = out["case_evidence_packs"].first()
    assert pack.explanation_text and pack.evidence_quality.scored
    assert out["case_alerts"].join(out["alerts"], "alert_id", "left_anti").count() == 0
    check_scores({r.account_id: r for r in run_queries.account_overview(out).collect()}, out)


def percentiles(values):
    """Mean rank of ties, of 100."""
    ordered = sorted(values.values())
    at = defaultdict(list)
    for k, v in enumerate(ordered, 1):
        at[v].append(k)
    return {a: sum(at[v]) / len(at[v]) / len(ordered) * 100 for a, v in values.items()}


def check_scores(found, out):
    """Account scores worked out anew from the run's own graph features, alerts and anomaly scores."""
    weights = {"pagerank_score": 0.25, "degree_centrality": 0.15, "betweenness_centrality": 0.15, "cycle_count": 0.15, "high_risk_alert_count": 0.2}
    graphs = {r.account_id: r for r in out["graph_features"].collect()}
    assert len({r.betweenness_centrality for r in graphs.values()}) > 1 and len({r.community_id for r in graphs.values()}) >= 1
    ranks = {c: percentiles({a: float(r[c] or 0) for a, r in graphs.items()}) for c in weights}
    worst, n = defaultdict(float), defaultdict(int)
    for r in out["alerts"].collect():
        worst[r.account_id] = max(worst[r.account_id], r.risk_score_rule, SEVERITY[r.severity])
        n[r.account_id] += 1
    best = {r.account_id: r.anomaly_score for r in out["account_anomaly_scores"].collect()}
    for a, r in found.items():
        hops = graphs[a].shortest_path_to_flagged
        near = 0.0 if hops is None else max(0.0, min(100.0, 125.0 - 25.0 * hops))
        graph = min(100.0, sum(ranks[c][a] * w for c, w in weights.items()) + near * 0.1)
        rule = min(100.0, worst[a] + (n[a] - 1) * 2.0) if n[a] else 0.0
        assert (r.rule_risk_score, r.graph_risk_score, r.anomaly_risk_score) == pytest.approx((rule, graph, best[a]))
        total = rule * 0.35 + graph * 0.25 + best[a] * 0.25 + r.customer_risk_score * 0.1 + r.jurisdiction_risk_score * 0.05
        assert r.account_risk_score == pytest.approx(total, abs=1e-5)
    order = sorted(found.values(), key=lambda r: (-r.account_risk_score, r.account_id))
    assert [r.risk_rank for r in order] == list(range(1, len(order) + 1))
    made = defaultdict(int)
    for r in out["cases"].collect():
        made[r.primary_account_id] += 1
    assert all(r.case_count == made[a] for a, r in found.items())


def test_the_run_as_a_query_takes_every_source(spark, sf, monkeypatch):
    taken = []
    monkeypatch.setattr(run_queries.service, "run", lambda *a: taken.append(a[3]))
    monkeypatch.setattr(run_queries, "account_overview", lambda out: out)
    run_queries.run_account_risk(spark, sf)
    assert taken[0].betweenness_sources is None
