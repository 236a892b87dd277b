"""Named queries of balance flow, alerts and text exports, with their SQL for DuckDB."""

from __future__ import annotations

from ledgerlark.operators import alerts, exports, flow

from .queries import _CATEGORY, _RECONCILED, _RISKS, LOOPS as _LOOPS, add

_BEFORE = "pre AS (SELECT *, lag(balance) OVER (PARTITION BY statement_id ORDER BY row_idx) AS before FROM ledger)"
_COUNTS = ", ".join(f"count(*) FILTER (WHERE {test}) AS {name}" for name, test in _RISKS.items())
_FOUND = f"""found AS (SELECT a.*, coalesce(l.n, 0) AS circularTrading FROM (
  SELECT statement_id, count(*) AS n_rows, count(*) FILTER (WHERE abs(difference) > 1) AS mismatches, count(*) FILTER (WHERE balance <= 0) AS zero_rows, {_COUNTS}
  FROM rec GROUP BY statement_id) a LEFT JOIN (SELECT statement_id, count(*) AS n FROM loops GROUP BY statement_id) l USING (statement_id))"""
_ALL = (_RECONCILED, _LOOPS, _FOUND)


def _money(x: str) -> str:
    return f"printf('%.2f', {x} / 100.0::DOUBLE)"


def _blank(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN '' ELSE {_money(x)} END"


_DAY = "concat(substr(date, 9, 2), '/', substr(date, 6, 2), '/', substr(date, 1, 4))"
_HEAD = "SELECT DISTINCT statement_id, 0 AS part, 0::BIGINT AS row_idx, {k} AS k, '{line}' AS line FROM ledger"
_LINE = "SELECT statement_id, 1 AS part, row_idx, {k} AS k, {line} AS line FROM ledger"

add(
    "balance_flow_score",
    flow.balance_flow,
    """SELECT *, CASE WHEN n_rows <= 1 THEN 0.0::DOUBLE WHEN checked = 0 THEN 1.0::DOUBLE ELSE (checked - matched)::DOUBLE / checked END AS mismatch_ratio
       FROM (SELECT statement_id, count(*) AS n_rows, count(before) AS checked, count(*) FILTER (WHERE abs(before + credit - debit - balance)
             <= greatest(5.0::DOUBLE, least(300.0::DOUBLE, greatest(debit, credit, abs(before), abs(balance)) * 0.0015::DOUBLE)) AND before IS NOT NULL) AS matched
             FROM pre GROUP BY statement_id)""",
    views=(_BEFORE,),
)
add(
    "delta_anomaly_rate",
    flow.delta_anomalies,
    """SELECT *, CASE WHEN checks > 0 THEN anomalies::DOUBLE / checks ELSE 0.0::DOUBLE END AS rate
       FROM (SELECT statement_id, count(*) FILTER (WHERE d >= 1000) AS checks, count(*) FILTER (WHERE d >= 1000 AND (a <= 0 OR
             (abs(d - a) > greatest(100.0::DOUBLE, d * 0.02::DOUBLE) AND (a < d * 0.6::DOUBLE OR abs(d - a) > d * 0.2::DOUBLE)))) AS anomalies
             FROM (SELECT statement_id, abs(balance - before) AS d, greatest(debit, credit) AS a FROM pre) GROUP BY statement_id)""",
    views=(_BEFORE,),
)
add(
    "statement_summary",
    flow.statement_summary,
    """SELECT statement_id, arg_min(balance - credit + debit, row_idx) AS opening, arg_max(balance, row_idx) AS closing, CAST(sum(credit) AS BIGINT) AS credits,
       CAST(sum(debit) AS BIGINT) AS debits, CAST(sum(credit) - sum(debit) AS BIGINT) AS net, count(*) AS n_rows, count(DISTINCT date) AS n_days
       FROM ledger GROUP BY statement_id""",
)
add("circular_transfers", alerts.circular, "SELECT * FROM loops", views=(_LOOPS,))
add(
    "circular_groups",
    alerts.circular_groups,
    """SELECT statement_id, counterparty, count(*) FILTER (WHERE category = 'Transfer In') AS n_in, count(*) FILTER (WHERE category = 'Transfer Out') AS n_out,
       CAST(sum(abs(CASE WHEN coalesce(debit, 0) <> 0 THEN debit ELSE coalesce(credit, 0) END)) AS BIGINT) AS total_amount
       FROM loops JOIN tra USING (statement_id, row_idx, counterparty) JOIN ledger USING (statement_id, row_idx) GROUP BY ALL""",
    views=(_LOOPS,),
)
add(
    "fraud_alerts",
    lambda df: alerts.fraud_alerts(alerts.findings(df)),
    """SELECT * FROM (
       SELECT statement_id, 'BALANCE_INTEGRITY' AS alert_type, CASE WHEN mismatches * 100.0::DOUBLE / n_rows > 20 THEN 'critical'
         WHEN mismatches * 100.0::DOUBLE / n_rows > 10 THEN 'high' WHEN mismatches * 100.0::DOUBLE / n_rows > 5 THEN 'medium' ELSE 'low' END AS severity, mismatches AS affected FROM found
       UNION ALL SELECT statement_id, 'GAMBLING', CASE WHEN gambling > 3 THEN 'high' ELSE 'medium' END, gambling FROM found
       UNION ALL SELECT statement_id, 'PAYDAYLOAN', 'high', paydayLoan FROM found
       UNION ALL SELECT statement_id, 'BOUNCEDPAYMENT', CASE WHEN bouncedPayment > 2 THEN 'critical' ELSE 'high' END, bouncedPayment FROM found
       UNION ALL SELECT statement_id, 'CIRCULARTRADING', CASE WHEN circularTrading > 8 THEN 'critical' ELSE 'high' END, circularTrading FROM found
       UNION ALL SELECT statement_id, 'LIQUIDITY_CRISIS', CASE WHEN zero_rows > 3 THEN 'critical' ELSE 'high' END, zero_rows FROM found) WHERE affected > 0""",
    views=_ALL,
)
add(
    "integrity_score",
    lambda df: alerts.integrity_score(alerts.findings(df)),
    """SELECT statement_id, CAST(greatest(0, 100 - least(35, mismatches * 3) - least(25, 5 * ((gambling > 0)::INT + (paydayLoan > 0)::INT
       + (bouncedPayment > 0)::INT + (circularTrading > 0)::INT)) - least(20, zero_rows * 5)) AS INTEGER) AS integrity_score FROM found""",
    views=_ALL,
)
_FIELDS = "concat_ws(',', date, description, {category}, {debit}, {credit}, {balance}, ref_number)"
add(
    "export_csv_lines",
    exports.csv_lines,
    _HEAD.format(k=0, line=exports.HEADER) + " UNION ALL "
    + _LINE.format(k=0, line=_FIELDS.format(category=_CATEGORY, **{c: _money(c) for c in ("debit", "credit", "balance")})),
)
add(
    "export_csv_total_lines",
    lambda df: exports.csv_lines(df, total=True),
    _HEAD.format(k=0, line=exports.HEADER) + " UNION ALL "
    + _LINE.format(k=0, line=_FIELDS.format(category=_CATEGORY, **{c: _blank(c) for c in ("debit", "credit", "balance")}))
    + f" UNION ALL SELECT statement_id, 2, 0, 0, concat(',TOTAL,,', {_money('sum(debit)')}, ',', {_money('sum(credit)')}, ',,') FROM ledger GROUP BY statement_id",
)
add(
    "export_accounting_csv_lines",
    exports.accounting_csv_lines,
    _HEAD.format(k=0, line="Date,Description,Debit,Credit") + " UNION ALL "
    + _LINE.format(k=0, line=f"concat_ws(',', {_DAY}, description, {_blank('debit')}, {_blank('credit')})"),
)
_MEMO = "CASE WHEN description = '' THEN 'Transaction' ELSE description END"
_COLUMNS = "\tTRNSTYPE\tDATE\tACCNT\tNAME\tAMOUNT\tMEMO"
_ENTRY = "concat_ws('\t', '{mark}', 'BANK', {day}, 'Bank', {memo}, {amount}, {memo})"
add(
    "export_iif_lines",
    exports.iif_lines,
    " UNION ALL ".join(
        [_HEAD.format(k=k, line=line) for k, line in enumerate([f"!TRNS{_COLUMNS}", f"!SPL{_COLUMNS}", "!ENDTRNS"])]
        + [_LINE.format(k=k, line=line) + " WHERE credit <> debit" for k, line in enumerate([
            _ENTRY.format(mark="TRNS", day=_DAY, memo=_MEMO, amount=_money("(credit - debit)")),
            _ENTRY.format(mark="SPL", day=_DAY, memo=_MEMO, amount=_money("(debit - credit)")),
            "'ENDTRNS'",
        ])]
    ),
)
add(
    "export_row_hash",
    exports.row_hashes,
    f"""SELECT statement_id, row_idx, sha256(concat_ws('|', date, lower(trim(description)), {_money('debit')}, {_money('credit')}, {_money('balance')})) AS row_hash FROM ledger""",
)
