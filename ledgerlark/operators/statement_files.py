"""Statement files: MT940 and Tally XML as lines, and a sink that writes one ordered file for each statement."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.dates import statement_day, tidy, trimmed

from .adjacent import BLOCK, renumber
from .exports import _around, _rows, money

# What stands for missing fields, and the lengths of fields.
NO_ACCOUNT, NO_NARRATIVE, NO_CURRENCY, NO_LEDGER = "UNKNOWN", "BANK TRANSACTION", "INR", "Suspense"
ACCOUNT_LENGTH, NARRATIVE_LENGTH, NARRATIVE_LINE, REFERENCE_LENGTH = 35, 130, 65, 16
CRLF = "\r\n"


def chronological(ledger: DataFrame, block: int = BLOCK) -> DataFrame:
    """Ledger rows by date, undated ones last and rows of a day in their order: row_idx anew, stated_row (the old one) and day."""
    return renumber(ledger.withColumnRenamed("row_idx", "stated_row").withColumn("day", statement_day(F.col("date"))), block, by=("day", "stated_row"))


def _clean(text: Column, length: int, other: str = "") -> Column:
    return F.coalesce(F.nullif(F.substring(tidy(F.coalesce(text, F.lit(""))), 1, length), F.lit("")), F.lit(other))


def _reference(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9]", ""), 1, REFERENCE_LENGTH)


def currency_code(text: Column) -> Column:
    code = F.upper(trimmed(F.coalesce(text, F.lit(""))))
    return F.when(code.rlike("^[A-Z]{3}$"), code).otherwise(NO_CURRENCY)


def _amount(x: Column) -> Column:
    return F.replace(money(F.abs(x)), F.lit("."), F.lit(","))


def _balance_line(mark: str, balance: Column, day: Column) -> Column:
    return F.concat(F.lit(mark), F.when(balance >= 0, "C").otherwise("D"), F.date_format(day, "yyMMdd"), F.col("_currency"), _amount(balance))


def mt940_lines(ledger: DataFrame, headers: DataFrame, today: datetime.date | None = None, block: int = BLOCK) -> DataFrame:
    """Lines of an MT940 statement for each statement of the ledger: statement_id, part, row_idx, k, line.

    headers: statement_id, iban, account_number, currency, opening_balance, closing_balance, reference; any may be null, and a
    statement may have no header. Without an opening balance, the first row's balance less its amounts counts; without a
    closing one, the last row's balance. Rows stand by date; an undated row has the closing date, which is that of the last
    row, else of the first, else today. Rows without an amount have no line.
    """
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("debit", "credit", "balance")}
    rows = chronological(ledger, block).withColumns(zero)
    edge = F.struct("day", (F.col("balance") - F.col("credit") + F.col("debit")).alias("before"), "balance")
    edges = rows.groupBy("statement_id").agg(F.min_by(edge, "row_idx").alias("first"), F.max_by(edge, "row_idx").alias("last"))
    known = edges.join(headers.select("statement_id", "iban", "account_number", "currency", "opening_balance", "closing_balance", "reference"), "statement_id", "left")
    opened = F.coalesce("first.day", F.lit(today) if today else F.current_date())
    known = known.withColumns({"_opened": opened, "_closed": F.coalesce(F.col("last.day"), opened), "_currency": currency_code(F.col("currency"))})
    account = F.coalesce(F.nullif(F.col("iban"), F.lit("")), F.col("account_number"))
    reference = F.coalesce(F.nullif(_reference(F.coalesce(F.substring(tidy(F.col("reference")), 1, 24), F.lit(""))), F.lit("")), F.concat(F.lit("STMT"), F.col("statement_id")))
    before = [
        F.concat(F.lit(":20:"), F.substring(reference, 1, REFERENCE_LENGTH)), F.concat(F.lit(":25:"), _clean(account, ACCOUNT_LENGTH, NO_ACCOUNT)), F.lit(":28C:00001/001"),
        _balance_line(":60F:", F.coalesce("opening_balance", "first.before"), F.col("_opened")),
    ]
    after = [_balance_line(":62F:", F.coalesce("closing_balance", "last.balance"), F.col("_closed"))]
    paid = rows.where("credit > 0 or debit > 0").join(known.select("statement_id", "_closed"), "statement_id")
    ref = _reference(F.substring(tidy(F.coalesce("ref_number", F.lit(""))), 1, 30))
    entry = F.concat(
        F.lit(":61:"), F.date_format(F.coalesce("day", "_closed"), "yyMMdd"), F.when(F.col("credit") > 0, "C").otherwise("D"),
        _amount(F.when(F.col("credit") > 0, F.col("credit")).otherwise(F.col("debit"))), F.lit("NTRF"), F.when(ref != "", F.concat(F.lit("//"), ref)).otherwise(""),
    )
    text = _clean(F.col("description"), NARRATIVE_LENGTH, NO_NARRATIVE)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / NARRATIVE_LINE).cast("int")), lambda i: F.concat(F.lit(":86:"), F.substring(text, i * NARRATIVE_LINE + 1, F.lit(NARRATIVE_LINE))))
    body = paid.select("statement_id", F.lit(1).alias("part"), "row_idx", F.posexplode(F.concat(F.array(entry), chunks)).alias("k", "line"))
    return body.unionByName(_around(known, before, after))


def tally_date(date: Column) -> Column:
    """Eight digits of a date: ISO without dashes, or any eight digits; else empty."""
    digits = F.regexp_replace(F.coalesce(date, F.lit("")), "[^0-9]", "")
    return F.when(F.length(digits) == 8, digits).otherwise("")


def xml_text(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def ledger_name(text: Column) -> Column:
    """A counterparty's name for a ledger: no angle brackets, single spaces."""
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\n\r\t]+", " "), r"\s{2,}", " ")
    return F.coalesce(F.nullif(trimmed(F.regexp_replace(spaced, "[<>]", "")), F.lit("")), F.lit(NO_LEDGER))


def tally_lines(ledger: DataFrame, today: datetime.date | None = None) -> DataFrame:
    """Lines of a Tally XML import for each statement: a receipt or a payment with two entries for each row with an amount.

    Vouchers are numbered by the first row's date (else today) and by all rows. Text is escaped; nothing is cut.
    """
    now = F.date_format(F.lit(today) if today else F.current_date(), "yyyyMMdd")
    own = ledger.groupBy("statement_id").agg(F.min_by("date", "row_idx").alias("date"))
    own = own.select("statement_id", F.coalesce(F.nullif(tally_date(F.col("date")), F.lit("")), now).alias("_statement"))
    debit, credit = (F.coalesce(c, F.lit(0)) for c in ("debit", "credit"))
    size, receipt = F.when(debit != 0, debit).otherwise(credit), credit > 0
    plain, minus = money(F.abs(size)), F.concat(F.lit("-"), money(F.abs(size)))
    text, ref = F.coalesce("description", F.lit("")), F.coalesce("ref_number", F.lit(""))
    said = F.concat_ws(" | ", F.nullif(text, F.lit("")), F.when(ref != "", F.concat(F.lit("Ref: "), ref)))
    row = F.col("row_idx") + 1
    number = F.concat(F.lit("VCH-"), F.col("_statement"), F.lit("-"), F.lpad(row.cast("string"), F.greatest(F.length(row.cast("string")), F.lit(3)), "0"))
    tag = lambda indent, name, x: F.concat(F.lit(" " * indent + f"<{name}>"), x, F.lit(f"</{name}>"))
    entry = lambda name, positive, x: [F.lit("        <ALLLEDGERENTRIES.LIST>"), tag(10, "LEDGERNAME", name), tag(10, "ISDEEMEDPOSITIVE", positive), tag(10, "AMOUNT", x), F.lit("        </ALLLEDGERENTRIES.LIST>")]
    lines = [
        F.lit('    <TALLYMESSAGE xmlns:UDF="TallyUDF">'), F.concat(F.lit('      <VOUCHER VCHTYPE="'), F.when(receipt, "Receipt").otherwise("Payment"), F.lit('" ACTION="Create">')),
        tag(8, "DATE", tally_date(F.col("date"))), tag(8, "VOUCHERNUMBER", number), tag(8, "NARRATION", xml_text(said)), tag(8, "REFERENCE", xml_text(ref)),
        *entry(F.lit("Bank"), F.when(receipt, "No").otherwise("Yes"), F.when(receipt, plain).otherwise(minus)),
        *entry(xml_text(ledger_name(F.col("description"))), F.when(receipt, "Yes").otherwise("No"), F.when(receipt, minus).otherwise(plain)),
        F.lit("      </VOUCHER>"), F.lit("    </TALLYMESSAGE>"),
    ]
    opening = ['<?xml version="1.0" encoding="UTF-8"?>', "<ENVELOPE>", "  <HEADER>", "    <TALLYREQUEST>Import Data</TALLYREQUEST>", "  </HEADER>", "  <BODY>", "    <IMPORTDATA>", "      <REQUESTDESC>", "        <REPORTNAME>Vouchers</REPORTNAME>", "      </REQUESTDESC>", "      <REQUESTDATA>"]
    closing = ["      </REQUESTDATA>", "    </IMPORTDATA>", "  </BODY>", "</ENVELOPE>"]
    return _rows(ledger.where(size != 0).join(own, "statement_id"), *lines).unionByName(_around(own, [F.lit(x) for x in opening], [F.lit(x) for x in closing]))


def write_files(lines: DataFrame, path: str, line_end: str = "\n") -> None:
    """One text file for each statement, in its folder ``statement_id=...`` under path (which must not exist), its lines in order.

    lines: statement_id, part, row_idx, k, line. A statement's lines are sorted by Spark, on disk where they are many, and
    streamed to its file by one task. Files appear when the whole job commits: a failed or lost task leaves nothing behind.
    """
    ordered = lines.repartition("statement_id").sortWithinPartitions("statement_id", "part", "row_idx", "k")
    ordered.select("statement_id", "line").write.partitionBy("statement_id").option("lineSep", line_end).mode("errorifexists").text(path)
