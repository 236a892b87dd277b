"""Named queries of statement files as lines, with their SQL for DuckDB."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ledgerlark.operators import export_checks, statement_files

from .dates import _PARTS, RAW
from .repairs import _EXPORT, ROUNDED, add_spoilt

_TODAY = datetime.date(2024, 1, 31)
#: Raw dates in statement order, long and empty narrations, amounts of both sides.
_SOURCE = [
    *RAW, "CASE row_idx % 7 WHEN 1 THEN NULL WHEN 3 THEN concat(description, '  & <', repeat('long narrative ', row_idx % 12), '>') ELSE description END AS description",
    "CASE WHEN row_idx % 5 = 2 THEN concat('a-', ref_number, '/', repeat('9', 20)) ELSE ref_number END AS ref_number", "CASE WHEN row_idx % 31 = 8 THEN NULL ELSE debit END AS debit", "credit", "balance - 40000000 AS balance",
]
_HEADERS = [
    "statement_id", "CASE WHEN statement_id % 3 = 0 THEN '' ELSE concat('AE 07 ', statement_id) END AS iban", "CASE WHEN statement_id % 6 = 0 THEN NULL ELSE '12-34' END AS account_number",
    "CASE statement_id % 4 WHEN 0 THEN ' usd' WHEN 1 THEN 'dollar' ELSE NULL END AS currency", "CASE WHEN statement_id % 5 = 0 THEN -250 ELSE NULL END AS opening_balance",
    "CASE WHEN statement_id % 5 = 1 THEN 777 ELSE NULL END AS closing_balance", "CASE WHEN statement_id % 2 = 0 THEN concat('ref-', statement_id, '/x') ELSE NULL END AS reference",
]
_FIXED = "replace(printf('%.2f', abs({0}) / 100.0::DOUBLE), '.', ',')"
_MT940 = rf"""ordered AS (SELECT l.statement_id, l.row_idx AS stated, coalesce(description, '') AS description, coalesce(ref_number, '') AS ref_number, coalesce(debit, 0) AS debit, credit, balance, day,
    row_number() OVER (PARTITION BY l.statement_id ORDER BY day NULLS LAST, l.row_idx) - 1 AS row_idx FROM ledger l LEFT JOIN days d ON d.statement_id = l.statement_id AND d.row_idx = l.row_idx),
heads AS (SELECT {', '.join(_HEADERS)} FROM (SELECT DISTINCT statement_id FROM ledger) WHERE statement_id % 11 <> 10),
edges AS (SELECT o.statement_id, coalesce(first.day, DATE '2024-01-31') AS opened, coalesce(last.day, first.day, DATE '2024-01-31') AS closed, coalesce(opening_balance, first.balance - first.credit + first.debit) AS ob, coalesce(closing_balance, last.balance) AS cb,
    CASE WHEN regexp_matches(upper(trim(currency)), '^[A-Z]{{3}}$') THEN upper(trim(currency)) ELSE 'INR' END AS cur, coalesce(nullif(iban, ''), account_number, 'UNKNOWN') AS account, coalesce(regexp_replace(reference, '[^A-Za-z0-9]', '', 'g'), 'STMT' || o.statement_id) AS reference
  FROM (SELECT statement_id, arg_min(ordered, row_idx) AS first, arg_max(ordered, row_idx) AS last FROM ordered GROUP BY statement_id) o LEFT JOIN heads h ON h.statement_id = o.statement_id),
entries AS (SELECT statement_id, 1 AS part, row_idx, list_concat([':61:' || strftime(coalesce(day, closed), '%y%m%d') || CASE WHEN credit > 0 THEN 'C' ELSE 'D' END || {_FIXED.format("CASE WHEN credit > 0 THEN credit ELSE debit END")} || 'NTRF'
      || CASE WHEN ref <> '' THEN '//' || ref ELSE '' END], list_filter([':86:' || substr(said, 1, 65), CASE WHEN length(said) > 65 THEN ':86:' || substr(said, 66) END], lambda x : x IS NOT NULL)) AS lines
  FROM (SELECT *, substr(regexp_replace(substr(ref_number, 1, 30), '[^A-Za-z0-9]', '', 'g'), 1, 16) AS ref, coalesce(nullif(substr(trim(regexp_replace(description, '\s+', ' ', 'g')), 1, 130), ''), 'BANK TRANSACTION') AS said
    FROM ordered JOIN edges USING (statement_id) WHERE credit > 0 OR debit > 0)),
whole AS (SELECT statement_id, 0 AS part, CAST(0 AS BIGINT) AS row_idx, [':20:' || substr(reference, 1, 16), ':25:' || account, ':28C:00001/001', ':60F:' || CASE WHEN ob >= 0 THEN 'C' ELSE 'D' END || strftime(opened, '%y%m%d') || cur || {_FIXED.format("ob")}] AS lines FROM edges
  UNION ALL SELECT statement_id, 2, 0, [':62F:' || CASE WHEN cb >= 0 THEN 'C' ELSE 'D' END || strftime(closed, '%y%m%d') || cur || {_FIXED.format("cb")}] FROM edges UNION ALL SELECT * FROM entries)"""
add_spoilt(
    "export_mt940_lines",
    _SOURCE,
    lambda df: statement_files.mt940_lines(df, df.select("statement_id").distinct().where("statement_id % 11 <> 10").selectExpr(*_HEADERS), _TODAY).select("statement_id", "part", "row_idx", "k", "line"),
    "SELECT statement_id, part, row_idx, CAST(unnest(range(len(lines))) AS INTEGER) AS k, unnest(lines) AS line FROM whole",
    views=(_PARTS, _MT940),
)
_XML = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
_DIGITS = "CASE WHEN length(regexp_replace(coalesce(date, ''), '[^0-9]', '', 'g')) = 8 THEN regexp_replace(date, '[^0-9]', '', 'g') ELSE '' END"
add_spoilt(
    "export_tally_vouchers",
    _SOURCE,
    lambda df: statement_files.tally_lines(df, _TODAY).where("part = 1 and k in (1, 2, 3, 4, 5, 7, 9, 12, 13, 14)").groupBy("statement_id", "row_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.trim("line").alias("line")))), lambda x: x["line"]), "\n").alias("voucher")),
    rf"""SELECT statement_id, row_idx, concat_ws(chr(10), '<VOUCHER VCHTYPE="' || CASE WHEN credit > 0 THEN 'Receipt' ELSE 'Payment' END || '" ACTION="Create">', '<DATE>' || own || '</DATE>',
         '<VOUCHERNUMBER>VCH-' || coalesce(nullif(first, ''), '20240131') || '-' || CASE WHEN row_idx < 999 THEN lpad((row_idx + 1)::VARCHAR, 3, '0') ELSE (row_idx + 1)::VARCHAR END || '</VOUCHERNUMBER>',
         '<NARRATION>' || {_XML.format("concat_ws(' | ', nullif(description, ''), CASE WHEN coalesce(ref_number, '') <> '' THEN 'Ref: ' || ref_number END)")} || '</NARRATION>', '<REFERENCE>' || {_XML.format("coalesce(ref_number, '')")} || '</REFERENCE>',
         '<LEDGERNAME>Bank</LEDGERNAME>', '<AMOUNT>' || CASE WHEN credit > 0 THEN '' ELSE '-' END || printf('%.2f', size / 100.0::DOUBLE) || '</AMOUNT>',
         '<LEDGERNAME>' || {_XML.format(r"coalesce(nullif(trim(regexp_replace(regexp_replace(coalesce(description, ''), '\s{2,}', ' ', 'g'), '[<>]', '', 'g')), ''), 'Suspense')")} || '</LEDGERNAME>',
         '<ISDEEMEDPOSITIVE>' || CASE WHEN credit > 0 THEN 'Yes' ELSE 'No' END || '</ISDEEMEDPOSITIVE>', '<AMOUNT>' || CASE WHEN credit > 0 THEN '-' ELSE '' END || printf('%.2f', size / 100.0::DOUBLE) || '</AMOUNT>') AS voucher
       FROM (SELECT *, {_DIGITS} AS own, first_value({_DIGITS}) OVER (PARTITION BY statement_id ORDER BY row_idx) AS first, CASE WHEN coalesce(debit, 0) <> 0 THEN debit ELSE credit END AS size FROM ledger) WHERE size <> 0""",
)
_UNCHECKED = [*RAW, "CASE WHEN row_idx % 37 = 4 THEN NULL WHEN row_idx % 14 = 5 THEN -debit ELSE debit END AS debit", ROUNDED[3], ROUNDED[4]]
_PREPARED = """prep AS (SELECT l.statement_id, l.row_idx, coalesce(iso, 'UNKNOWN') AS date, abs(coalesce(debit, 0)) AS debit, abs(coalesce(credit, 0)) AS credit, coalesce(balance, 0) AS balance, list_filter([
    CASE WHEN iso IS NULL THEN 'invalid_date' END, CASE WHEN debit IS NULL THEN 'invalid_debit' END, CASE WHEN credit IS NULL THEN 'invalid_credit' END, CASE WHEN balance IS NULL THEN 'invalid_balance' END,
    CASE WHEN debit < 0 OR credit < 0 THEN 'negative_amount_normalized' END], lambda x : x IS NOT NULL) AS found FROM ledger l LEFT JOIN days d ON d.statement_id = l.statement_id AND d.row_idx = l.row_idx)"""
_CHECKED = """checked AS (SELECT p.statement_id, p.row_idx, date, debit, credit, repaired_balance AS balance, list_concat(found, CASE WHEN issue IS NULL THEN [] ELSE [issue] END) AS issues
  FROM prep p JOIN issues i ON i.statement_id = p.statement_id AND i.row_idx = p.row_idx)"""
_CHECKS = (_PARTS, _PREPARED, _EXPORT.replace("FROM ledger", "FROM prep").replace("JOIN ledger", "JOIN prep"), _CHECKED)
_TRUST = "statement_id, CASE statement_id % 4 WHEN 0 THEN 0.9D WHEN 1 THEN 0.5D WHEN 2 THEN 1.7D END AS confidence, CASE statement_id % 3 WHEN 0 THEN array('Tampered_Document', 'x') WHEN 1 THEN array('y') END AS fraud_flags"
add_spoilt(
    "export_checked_rows",
    _UNCHECKED,
    lambda df: export_checks.checked_rows(df).select("statement_id", "row_idx", "date", "debit", "credit", "balance", F.array_join("issues", ",").alias("issues")),
    "SELECT statement_id, row_idx, date, debit, credit, balance, array_to_string(issues, ',') AS issues FROM checked",
    views=_CHECKS,
)
add_spoilt(
    "export_report",
    _UNCHECKED,
    lambda df: export_checks.export_report(export_checks.checked_rows(df), df.select("statement_id").distinct().where("statement_id % 9 <> 8").selectExpr(*_TRUST.replace(", CASE", "|CASE").split("|"))).withColumn("warnings", F.array_join("warnings", " ")),
    """SELECT statement_id, n_rows, flagged_rows, major_issues, minor_issues, fraud_risk, export_confidence, export_confidence > 0.35 AS is_trusted, concat_ws(' ', CASE WHEN major_issues > 0 THEN printf('Detected %d major validation issue(s).', major_issues) END,
         CASE WHEN minor_issues > 0 THEN printf('Applied %d minor validation fix(es).', minor_issues) END, CASE WHEN n > 0 THEN printf('Fraud flags detected (%d).', n) END) AS warnings
       FROM (SELECT *, CASE WHEN confidence IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, floor((confidence - CASE WHEN minor_issues > 0 THEN 0.08::DOUBLE ELSE 0 END - CASE WHEN major_issues > 0 THEN least(0.35::DOUBLE, 0.1::DOUBLE + major_issues * 0.05::DOUBLE) ELSE 0 END
           - CASE WHEN n > 0 THEN 0.05::DOUBLE ELSE 0 END - CASE WHEN n = 2 THEN 0.1::DOUBLE ELSE 0 END) * 100 + 0.5) / 100)) END AS export_confidence, CASE n WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS fraud_risk
         FROM (SELECT *, CASE WHEN statement_id % 9 = 8 THEN NULL ELSE CASE statement_id % 4 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 1.0::DOUBLE END END AS confidence,
             CASE WHEN statement_id % 9 = 8 THEN 0 ELSE CASE statement_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END END AS n
           FROM (SELECT statement_id, count(*) AS n_rows, count(*) FILTER (len(issues) > 0) AS flagged_rows, CAST(sum(len(issues) - len(list_filter(issues, lambda x : x IN ('negative_amount_normalized', 'balance_minor_rounding_fix')))) AS BIGINT) AS major_issues,
               CAST(sum(len(list_filter(issues, lambda x : x IN ('negative_amount_normalized', 'balance_minor_rounding_fix')))) AS BIGINT) AS minor_issues FROM checked GROUP BY statement_id)))""",
    views=_CHECKS,
)
