"""Text exports as tables of lines; a writer sorts them by statement_id, part, row_idx, k.

part is 0 for the lines before the rows, 1 for those of rows, 2 for those after them; k counts the lines of one row.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.rules import category

HEADER = "Date,Description,Category,Debit,Credit,Balance,Reference"


def money(name: str | Column) -> Column:
    """Minor units as text with two decimals; null is zero."""
    x = F.col(name) if isinstance(name, str) else name
    return (F.coalesce(x, F.lit(0)) * F.lit(Decimal("0.01"))).cast("string")


def blank(name: str) -> Column:
    """As money, but empty for zero."""
    return F.when(F.coalesce(F.col(name), F.lit(0)) == 0, "").otherwise(money(name))


def field(x: Column) -> Column:
    """A CSV field, quoted only if it holds a quote, a comma or a line feed; null is empty."""
    x = F.coalesce(x, F.lit(""))
    return F.when(x.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def tidy(x: Column, length: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")), 1, length)


def day(form: str) -> Column:
    """The date in another form; text that is no date stays."""
    return F.coalesce(F.date_format(F.try_to_date("date", "yyyy-MM-dd"), form), F.col("date"), F.lit(""))


def _rows(ledger: DataFrame, *lines: Column) -> DataFrame:
    return ledger.select("statement_id", F.lit(1).alias("part"), "row_idx", F.posexplode(F.array(*lines)).alias("k", "line"))


def _around(per_statement: DataFrame, before: list[Column], after: list[Column] = ()) -> DataFrame:
    lines = [(0, i, x) for i, x in enumerate(before)] + [(2, i, x) for i, x in enumerate(after)]
    every = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(0).cast("long").alias("row_idx"), F.lit(i).alias("k"), x.alias("line")) for p, i, x in lines])
    return per_statement.select("statement_id", F.inline(every))


def csv_lines(ledger: DataFrame, total: bool = False) -> DataFrame:
    """Seven columns a row. total: zero amounts are blank and a TOTAL line follows the rows."""
    amount = blank if total else money
    fields = [F.col("date"), F.col("description"), category(F.col("description")), amount("debit"), amount("credit"), amount("balance"), F.col("ref_number")]
    sums = ledger.groupBy("statement_id").agg(F.sum("debit").alias("debit"), F.sum("credit").alias("credit"))
    last = [F.concat(F.lit(",TOTAL,,"), money("debit"), F.lit(","), money("credit"), F.lit(",,"))] if total else []
    return _rows(ledger, F.concat_ws(",", *map(field, fields))).unionByName(_around(sums, [F.lit(HEADER)], last))


def accounting_csv_lines(ledger: DataFrame) -> DataFrame:
    """Four columns a row, dates as day/month/year, zero amounts blank."""
    fields = [day("dd/MM/yyyy"), tidy(F.col("description"), 250), blank("debit"), blank("credit")]
    return _rows(ledger, F.concat_ws(",", *map(field, fields))).unionByName(_around(ledger.select("statement_id").distinct(), [F.lit("Date,Description,Debit,Credit")]))


def iif_lines(ledger: DataFrame, account: str = "Bank") -> DataFrame:
    """Three tab-separated lines for each row whose credit and debit differ: the entry, its opposite, the end mark."""
    net = F.coalesce(F.col("credit"), F.lit(0)) - F.coalesce(F.col("debit"), F.lit(0))
    text = F.coalesce(F.nullif(tidy(F.col("description"), 250), F.lit("")), F.lit("Transaction"))
    entry = lambda mark, x: F.concat_ws("\t", F.lit(mark), F.lit("BANK"), day("dd/MM/yyyy"), F.lit(account), text, money(x), text)
    columns = "TRNSTYPE\tDATE\tACCNT\tNAME\tAMOUNT\tMEMO"
    before = [F.lit(f"!TRNS\t{columns}"), F.lit(f"!SPL\t{columns}"), F.lit("!ENDTRNS")]
    rows = _rows(ledger.where(net != 0), entry("TRNS", net), entry("SPL", -net), F.lit("ENDTRNS"))
    return rows.unionByName(_around(ledger.select("statement_id").distinct(), before))


def row_hashes(ledger: DataFrame) -> DataFrame:
    """SHA-256 of date, description, debit, credit and balance of each row."""
    text = [F.coalesce("date", F.lit("")), F.lower(F.trim(F.coalesce("description", F.lit("")))), money("debit"), money("credit"), money("balance")]
    return ledger.select("statement_id", "row_idx", F.sha2(F.concat_ws("|", *text), 256).alias("row_hash"))
