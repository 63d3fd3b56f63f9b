"""DuckDB SQL equivalents, composed from named common table expressions."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}

CTES["tx"] = """
SELECT 'TXN_' || event_id AS transaction_id, 'ACC_' || user_id AS sender_account_id,
  CASE WHEN event_id % 5 <> 0 THEN 'ACC_' || ((user_id * 31 + event_id * 17) % n) END AS receiver_account_id,
  'CP_' || (event_id % 40) AS counterparty_id, 'DEV_' || (event_id % 50) AS device_id, ts AS transaction_timestamp, epoch_us(ts) AS us,
  CAST(round(value * 200, 2) AS DECIMAL(18,2)) AS amount,
  CASE event_type WHEN 'view' THEN 'transfer' WHEN 'click' THEN 'wire' WHEN 'purchase' THEN 'card_payment' WHEN 'signup' THEN 'cash_deposit' WHEN 'error' THEN 'cash_withdrawal' END AS transaction_type,
  'C' || (user_id % 25) AS origin_country, 'C' || (event_id % 25) AS destination_country, (user_id % 25) <> (event_id % 25) AS is_cross_border
FROM events, (SELECT max(user_id) + 1 AS n FROM events)"""
CTES["txo"] = """
SELECT 'ORD_' || o_orderkey AS transaction_id, 'A' || o_custkey AS sender_account_id, 'A' || ((o_custkey * 7 + o_orderkey * 13) % n) AS receiver_account_id,
  CAST(NULL AS VARCHAR) AS counterparty_id, o_orderdate AS transaction_timestamp, epoch_us(o_orderdate) AS us, CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) AS amount,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'transfer' WHEN o_orderpriority LIKE '2%' THEN 'wire' ELSE 'cash_withdrawal' END AS transaction_type
FROM orders, (SELECT max(c_custkey) + 1 AS n FROM customer)"""
CTES["acc"] = """
SELECT 'ACC_' || user_id AS account_id, 'CUST_' || (user_id // 2) AS customer_id, CASE WHEN user_id % 10 = 9 THEN 'closed' ELSE 'active' END AS account_status,
  'C' || (user_id % 25) AS home_country, ['low', 'medium', 'high', 'unknown'][user_id % 4 + 1] AS customer_risk_rating
FROM (SELECT DISTINCT user_id FROM events)"""
CTES["acco"] = "SELECT 'A' || c_custkey AS account_id, 'CUST_' || c_custkey AS customer_id, 'C' || c_nationkey AS home_country FROM customer"
CTES["ctry"] = "SELECT 'C' || n_nationkey AS country_code, n_nationkey % 6 = 0 AS is_high_risk, CASE WHEN n_nationkey % 7 <> 3 THEN CAST(n_nationkey * 4 % 101 AS DOUBLE) END AS risk_score FROM nation"

HOUR, DAY = 3_600_000_000, 86_400_000_000


def iso(ts: str) -> str:
    return f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({ts}) % 1000000 <> 0 THEN strftime({ts}, '.%f') ELSE '' END || '+00:00')"


# candidates
CTES["c_struct"] = "SELECT *, sender_account_id AS account_id, '' AS other FROM {tx} WHERE transaction_type IN ('transfer', 'wire') AND amount >= 5000 AND amount < 10000"
CTES["c_in"] = "SELECT *, receiver_account_id AS account_id, sender_account_id AS other FROM {tx} WHERE transaction_type IN ('transfer', 'wire') AND receiver_account_id IS NOT NULL AND receiver_account_id <> sender_account_id"
CTES["c_out"] = "SELECT *, sender_account_id AS account_id, coalesce(receiver_account_id, counterparty_id) AS other FROM {tx} WHERE transaction_type IN ('transfer', 'wire') AND (receiver_account_id IS NULL OR receiver_account_id <> sender_account_id)"
CTES["r_in"] = "SELECT *, receiver_account_id AS account_id, '' AS other FROM {tx} WHERE transaction_type IN ('transfer', 'wire', 'cash_deposit') AND receiver_account_id IS NOT NULL"
CTES["r_out"] = "SELECT *, sender_account_id AS account_id, coalesce(receiver_account_id, counterparty_id) AS other FROM {tx} WHERE transaction_type IN ('transfer', 'wire', 'cash_withdrawal') AND (receiver_account_id IS NULL OR receiver_account_id <> sender_account_id)"


def counted(name: str, candidates: str, width: int, least: int, distinct: bool) -> None:
    """CTEs for the strongest forward window of each account and what is in it."""
    frame = f"OVER (PARTITION BY account_id ORDER BY us RANGE BETWEEN CURRENT ROW AND {width} FOLLOWING)"
    strength = f"len(list_distinct(list(other) {frame}))" if distinct else f"count(*) {frame}"
    CTES[f"{name}_w"] = f"SELECT account_id, us, count(*) {frame} AS n, sum(amount) {frame} AS total, {strength} AS strength FROM {{{candidates}}}"
    CTES[f"{name}_s"] = f"SELECT account_id, us AS start_us FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY strength DESC, n DESC, total DESC, us) AS k FROM {{{name}_w}} WHERE strength >= {least}) WHERE k = 1"
    CTES[f"{name}_d"] = f"""
SELECT c.account_id, min(transaction_timestamp) AS s, max(transaction_timestamp) AS e, count(*) AS transaction_count, sum(amount) AS total_amount, min(amount) AS min_amount, max(amount) AS max_amount,
  list_sort(list(DISTINCT other)) AS others, list(transaction_id ORDER BY us, transaction_id) AS evidence_ids
FROM {{{candidates}}} c JOIN {{{name}_s}} s ON c.account_id = s.account_id AND c.us BETWEEN s.start_us AND s.start_us + {width} GROUP BY c.account_id"""


counted("st", "c_struct", 48 * HOUR, 3, False)
counted("fi", "c_in", 7 * DAY, 8, True)
counted("fo", "c_out", 7 * DAY, 10, True)

_F = f"OVER (PARTITION BY account_id ORDER BY us RANGE BETWEEN CURRENT ROW AND {48 * HOUR} FOLLOWING)"
CTES["rm_u"] = "SELECT account_id, us, transaction_id, transaction_timestamp, amount, other, 0 AS o FROM {r_in} UNION ALL SELECT account_id, us, transaction_id, transaction_timestamp, amount, other, 1 AS o FROM {r_out}"
CTES["rm_w"] = f"SELECT account_id, us, o, sum(CASE WHEN o = 0 THEN amount ELSE 0 END) {_F} AS received, sum(CASE WHEN o = 1 THEN amount ELSE 0 END) {_F} AS sent, sum(o) {_F} AS n_out FROM {{rm_u}}"
CTES["rm_s"] = """
SELECT account_id, us AS start_us FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY CAST(sent AS DOUBLE) / CAST(received AS DOUBLE) DESC, sent DESC, received DESC, us) AS k FROM {rm_w}
  WHERE o = 0 AND received >= 1000 AND n_out >= 1 AND CAST(sent AS DOUBLE) / CAST(received AS DOUBLE) >= 0.9 AND CAST(greatest(received - sent, 0) AS DOUBLE) / CAST(received AS DOUBLE) <= 0.1) WHERE k = 1"""
CTES["rm_d"] = f"""
SELECT u.account_id, min(CASE WHEN o = 0 THEN transaction_timestamp END) AS s, count(*) FILTER (o = 0) AS n_in, count(*) FILTER (o = 1) AS n_out, sum(amount) FILTER (o = 0) AS received, sum(amount) FILTER (o = 1) AS sent,
  list(transaction_id ORDER BY us, transaction_id) FILTER (o = 0) || list(transaction_id ORDER BY us, other, transaction_id) FILTER (o = 1) AS evidence_ids
FROM {{rm_u}} u JOIN {{rm_s}} s ON u.account_id = s.account_id AND u.us BETWEEN s.start_us AND s.start_us + {48 * HOUR} GROUP BY u.account_id"""

CTES["dr_c"] = "SELECT *, sender_account_id AS account_id, receiver_account_id AS other FROM {txo} WHERE amount >= 200000 AND sender_account_id <> receiver_account_id"
CTES["dr_h"] = "SELECT sender_account_id AS account_id, us, transaction_id FROM {txo} UNION ALL SELECT receiver_account_id, us, transaction_id FROM {txo}"
CTES["dr_p"] = "SELECT c.account_id, c.us, max(struct_pack(us := h.us, id := h.transaction_id)) AS prior FROM (SELECT DISTINCT account_id, us FROM {dr_c}) c JOIN {dr_h} h ON h.account_id = c.account_id AND h.us < c.us GROUP BY c.account_id, c.us"
CTES["dr_w"] = f"""
SELECT c.account_id, c.us, p.prior, date_diff('day', CAST(make_timestamp(p.prior.us) AS DATE), CAST(c.transaction_timestamp AS DATE)) AS days, c.total, c.n
FROM (SELECT *, sum(amount) OVER w AS total, count(*) OVER w AS n FROM {{dr_c}} WINDOW w AS (PARTITION BY account_id ORDER BY us RANGE BETWEEN CURRENT ROW AND {7 * DAY} FOLLOWING)) c JOIN {{dr_p}} p USING (account_id, us)"""
CTES["dr_s"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY days DESC, total DESC, n DESC, us) AS k FROM {dr_w} WHERE days >= 120 AND total >= 200000) WHERE k = 1"
CTES["dr_d"] = f"""
SELECT c.account_id, any_value(s.days) AS days, any_value(s.prior) AS prior, min(c.transaction_timestamp) AS s, count(*) AS n, sum(amount) AS total, max(amount) AS most, count(DISTINCT other) AS recipients,
  list(transaction_id ORDER BY c.us, other, transaction_id) AS reactivation
FROM {{dr_c}} c JOIN {{dr_s}} s ON c.account_id = s.account_id AND c.us BETWEEN s.us AND s.us + {7 * DAY} GROUP BY c.account_id"""

CTES["cf_e"] = "SELECT sender_account_id AS source, receiver_account_id AS target, transaction_id, transaction_timestamp, us, amount FROM {txo} WHERE transaction_type IN ('transfer', 'wire') AND sender_account_id <> receiver_account_id"
CTES["cf_g"] = "SELECT DISTINCT source, target FROM {cf_e}"
CTES["cf_c"] = """
SELECT [a.source, a.target] AS accounts FROM {cf_g} a JOIN {cf_g} b ON a.target = b.source AND b.target = a.source WHERE a.source < a.target
UNION ALL SELECT [a.source, a.target, b.target] FROM {cf_g} a JOIN {cf_g} b ON a.target = b.source JOIN {cf_g} c ON b.target = c.source AND c.target = a.source WHERE a.source < a.target AND a.source < b.target
UNION ALL SELECT [a.source, a.target, b.target, c.target] FROM {cf_g} a JOIN {cf_g} b ON a.target = b.source JOIN {cf_g} c ON b.target = c.source JOIN {cf_g} d ON c.target = d.source AND d.target = a.source
  WHERE a.source < a.target AND a.source < b.target AND a.source < c.target AND a.target <> c.target"""
CTES["cf_t"] = "SELECT accounts, unnest(range(len(accounts))) AS step FROM {cf_c}"
CTES["cf_a"] = f"""
SELECT accounts, min(transaction_timestamp) AS s, max(transaction_timestamp) AS e, (max(us) - min(us)) / {HOUR} AS hours, count(*) AS n, sum(amount) AS total, min(amount) AS least, max(amount) AS most, list(transaction_id ORDER BY step, us, transaction_id) AS evidence_ids
FROM {{cf_t}} t JOIN {{cf_e}} e ON e.source = t.accounts[t.step + 1] AND e.target = t.accounts[(t.step + 1) % len(t.accounts) + 1] GROUP BY accounts"""
CTES["cf_i"] = f"SELECT *, 'CF_' || upper(substr(sha256(array_to_string(accounts, '|') || '||' || array_to_string(list_sort(evidence_ids), '|')), 1, 8)) AS cycle_id, accounts[1] AS account_id, {iso('s')} AS ws, {iso('e')} AS we FROM {{cf_a}}"
CTES["cf_k"] = "SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY len(accounts), ws, cycle_id) AS k FROM {cf_i}"
CTES["cf_d"] = "SELECT * FROM {cf_k} WHERE k <= 3 ORDER BY account_id, len(accounts), ws, cycle_id LIMIT 500"


def alerts(name: str, rule: str, typology: str, detections: str, accounts: str, base: float, raised: str, reason: str, start: str, end: str, evidence: str = "evidence_ids") -> None:
    part = re.sub("[^A-Za-z0-9]+", "_", rule).strip("_").upper()
    CTES[name] = f"""
SELECT 'AL_{part}_' || upper(substr(sha256(concat_ws('|', '{part}', d.account_id, {start}, array_to_string(list_sort({evidence}), '|'))), 1, 8)) AS alert_id, d.account_id, a.customer_id, '{rule}' AS rule_name,
  '{typology}' AS typology, 'high' AS severity, CASE WHEN {raised} THEN 90.0::DOUBLE ELSE {base}::DOUBLE END AS risk_score_rule, {reason} AS reason_code, {evidence} AS evidence_ids, {start} AS detection_window_start, {end} AS detection_window_end
FROM {{{detections}}} d LEFT JOIN {{{accounts}}} a ON d.account_id = a.account_id"""


alerts("al_st", "Structuring", "structuring", "st_d", "acc", 80, "transaction_count >= 4.5", "transaction_count || ' transfers below threshold within 48 hours'", iso("s"), iso("e"))
alerts("al_fi", "Fan-in", "fan_in", "fi_d", "acc", 80, "len(others) >= 12", "len(others) || ' unique senders within 7 days'", iso("s"), iso("e"))
alerts("al_fo", "Fan-out", "fan_out", "fo_d", "acc", 80, "len(others) >= 15", "len(others) || ' unique recipients within 7 days'", iso("s"), iso("e"))
_RATIO = "(CAST(sent AS DOUBLE) / CAST(received AS DOUBLE))"
alerts("al_rm", "Rapid movement", "rapid_movement", "rm_d", "acc", 80, f"{_RATIO} >= 0.98", f"CAST(round_even({_RATIO} * 100, 0) AS BIGINT) || ' percent of received value sent out within 48 hours'", iso("s"), iso("(s + INTERVAL 48 HOUR)"))
alerts("al_dr", "Dormant reactivation", "dormant_reactivation", "dr_d", "acco", 80, "total >= 400000", "days || ' inactive days followed by ' || total || ' outbound value within 7 days'", iso("s"), iso("(s + INTERVAL 7 DAY)"), "([prior.id] || reactivation)")
alerts("al_cf", "Circular flow", "circular_flow", "cf_d", "acco", 85, "total >= 50000 OR len(accounts) >= 4", "len(accounts) || '-account circular flow with ' || total || ' total value over ' || printf('%.1f', hours) || ' hours'", "ws", "we")
#: Alerts of all cycles, none dropped after a number.
alerts("al_cw", "Circular flow", "circular_flow", "cf_i", "acco", 85, "total >= 50000 OR len(accounts) >= 4", "len(accounts) || '-account circular flow with ' || total || ' total value over ' || printf('%.1f', hours) || ' hours'", "ws", "we")
CTES["al"] = " UNION ALL ".join(f"SELECT * FROM {{{x}}}" for x in ("al_st", "al_fi", "al_fo", "al_rm"))


def compose(query: str) -> str:
    """``query`` with {name} for common table expressions, which are put in front in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\{(\w+)\}", text):
            if name not in order:
                visit(CTES[name])
                if name not in order:
                    order.append(name)

    visit(query)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    return (f"WITH {', '.join(f'{n} AS MATERIALIZED ({plain(CTES[n])})' for n in order)} " if order else "") + plain(query)
