"""Named queries of rows from the text of statements. The grammar of lines is tested against plain loops; SQL has no machine to follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions.references import best_reference
from ledgerlark.operators import layout, lines, scanned, tables
from ledgerlark.sources.ledger import ledger

from .queries import QUERIES

#: Three lines for each ledger row: most rows begin with their date, some are broken over lines, pages end and have headers.
_MONEY = "{0} div 100 || '.' || lpad(cast({0} % 100 as string), 2, '0')"
_D, _C, _B = (_MONEY.format(c) for c in ("debit", "credit", "abs(balance)"))
_LINES = f"""SELECT statement_id, row_idx * 3 + at AS row_idx, line FROM (
  SELECT statement_id, row_idx, posexplode(array(
    CASE WHEN row_idx % 40 = 39 THEN '{lines.PAGE_BREAK}' WHEN row_idx % 5 = 4 THEN 'Opening Balance carried' ELSE '' END,
    CASE row_idx % 4 WHEN 0 THEN concat(date_format(cast(date AS date), 'dd/MM/yyyy'), ' ', description, ' ', CASE WHEN debit > 0 THEN {_D} ELSE '-' END, ' ', CASE WHEN debit > 0 THEN '-' ELSE {_C} END, ' ', {_B})
      WHEN 1 THEN concat(date_format(cast(date AS date), 'd MMM yyyy'), ' ', description)
      WHEN 2 THEN concat(row_idx, ' ', date_format(cast(date AS date), 'dd-MM-yy'), ' ', description, ' ', CASE WHEN debit > 0 THEN {_D} ELSE {_C} END, ' ', {_B})
      ELSE concat('ref ', ref_number) END,
    CASE row_idx % 4 WHEN 1 THEN concat('part two ', CASE WHEN debit > 0 THEN {_D} ELSE '-' END, ' ', CASE WHEN debit > 0 THEN '-' ELSE {_C} END, ' ', {_B})
      WHEN 3 THEN concat('(', {_D}, ')') ELSE concat('note of ', row_idx) END)) AS (at, line)
  FROM {{ledger}})"""


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_LINES, ledger=ledger(spark, sf_dir, "orders"))


QUERIES["assembled_rows"] = lambda spark, sf_dir: lines.assemble_rows(statement_lines(spark, sf_dir))


#: Two tables of different headings in each document, before and after its own text; some rows can't be read.
_TABLES = r"""doc_id, concat_ws('
',
  'Txn Date | Value Date | Narration | Chq No | Debit | Credit | Running Balance', '---|---|:---|---|---|---|---:',
  concat('0', doc_id % 9 + 1, '/02/2024 | | Shop ', doc_id % 7, ' | #REF-', doc_id, ' | ', doc_id % 100, '.', doc_id % 90 + 10, ' | | ', doc_id, ',000.50'),
  concat(CASE WHEN doc_id % 5 = 0 THEN 'soon' ELSE concat(doc_id % 28 + 1, '-Feb-24') END, ' | | ', CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ' | ', source, ' | | 1.', doc_id % 900 + 100, ',05 | ', CASE WHEN doc_id % 4 = 0 THEN '-' ELSE '7.25 CR' END),
  text, '| Date | Note | Balance |', CASE WHEN doc_id % 6 = 0 THEN 'no dashes' ELSE '| -- | -- | -- |' END, concat('| Mar ', doc_id % 28 + 1, ', 2024 | ', lang, ' | ', doc_id % 50, ' |'), 'end') AS text"""


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", _TABLES.split(", ", 1)[1])
    return tables.table_rows(tables.text_lines(documents))


QUERIES["table_rows"] = table_rows


#: Tokens of sixty rows a page; every third statement has headings, the others show their columns by their amounts.
_PLACES = """SELECT statement_id, CAST(row_idx div 60 + 1 AS INT) AS page, x + row_idx % 3 AS x, 800 - 12 * (row_idx % 60) - x / 400 AS y, text FROM (
  SELECT statement_id, row_idx, inline(array(named_struct('x', 60.0D, 'text', date), named_struct('x', 120.0D, 'text', description), named_struct('x', 250.0D, 'text', ref_number),
    named_struct('x', CASE WHEN debit > 0 THEN 335.0D ELSE 415.0D END, 'text', CASE WHEN debit > 0 THEN {_D} ELSE {_C} END), named_struct('x', 501.0D, 'text', {_B}),
    named_struct('x', 335.0D, 'text', CASE WHEN row_idx % 60 = 0 AND statement_id % 3 = 0 THEN 'Debit' END), named_struct('x', 415.0D, 'text', CASE WHEN row_idx % 60 = 0 AND statement_id % 3 = 0 THEN 'Credit' END),
    named_struct('x', 501.0D, 'text', CASE WHEN row_idx % 60 = 0 AND statement_id % 3 = 0 THEN 'Balance' END))) FROM {ledger})""".replace("{_D}", _D).replace("{_C}", _C).replace("{_B}", _B)


def column_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = layout.group_lines(spark.sql(_PLACES, ledger=ledger(spark, sf_dir, "orders")))
    return layout.anchored_amounts(placed, layout.detect_layout(placed))


def best_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References hidden in the ledger's reference fields in several ways."""
    field = F.expr(
        "CASE row_idx % 6 WHEN 0 THEN concat('UTR: ', ref_number, '00', row_idx) WHEN 1 THEN concat(description, ' AE', 100000 + row_idx) WHEN 2 THEN concat('#', ref_number, '-ABCDEFGH-', row_idx % 90 + 10) "
        "WHEN 3 THEN description WHEN 4 THEN '05/06/2024' ELSE concat('paid ', 1000000000 + row_idx, ' FCF12AB', row_idx) END"
    )
    return ledger(spark, sf_dir, "orders").select("statement_id", "row_idx", best_reference(field, F.col("description")).alias("reference"))


QUERIES |= {"column_amounts": column_amounts, "best_references": best_references}

#: The ledger as scans read it: dates in three forms, misread digits, amounts on both sides or beside a type, missing balances.
_SCANS = [
    "statement_id", "row_idx", "CASE row_idx % 3 WHEN 0 THEN date WHEN 1 THEN date_format(cast(date AS date), 'dd/MM/yy') ELSE date_format(cast(date AS date), 'dd-MMM-yy') END AS date",
    "CASE WHEN row_idx % 17 = 5 THEN 'Page 4 of 9' ELSE description END AS description", "concat('Ref: ', ref_number, row_idx) AS ref_number", f"CASE WHEN row_idx % 7 = 2 THEN NULL ELSE translate({_D}, CASE WHEN row_idx % 5 = 1 THEN '0' ELSE '' END, 'O') END AS debit",
    f"CASE WHEN row_idx % 7 = 2 THEN NULL WHEN row_idx % 11 = 3 THEN {_D} ELSE {_C} END AS credit", f"CASE WHEN row_idx % 23 = 4 THEN 'n/a' ELSE concat({_B}, CASE WHEN balance < 0 THEN '-' ELSE '' END) END AS balance",
    f"CASE WHEN row_idx % 7 = 2 THEN CASE WHEN debit > 0 THEN {_D} ELSE {_C} END END AS amount", "CASE WHEN row_idx % 7 = 2 THEN CASE WHEN debit > 0 THEN 'DR' ELSE 'Credit' END END AS type",
]


def scanned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.scanned_rows(ledger(spark, sf_dir, "orders").selectExpr(*_SCANS))


QUERIES |= {"scanned_rows": scanned_rows, "scan_summary": lambda spark, sf_dir: scanned.scan_summary(scanned_rows(spark, sf_dir)).withColumn("issues", F.array_join("issues", ","))}
