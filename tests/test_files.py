"""Statement files: their lines, and the files that a job writes."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import statement_files as files

SCHEMA = "statement_id long, row_idx long, date string, description string, ref_number string, debit long, credit long, balance long"
HEADER = "statement_id long, iban string, account_number string, currency string, opening_balance long, closing_balance long, reference string"
TODAY = datetime.date(2024, 5, 6)


def read(path):
    return {p.name.split("=")[1]: b"".join(f.read_bytes() for f in sorted(p.glob("part-*"))) for p in path.iterdir() if p.is_dir()}


def test_mt940_file(spark, tmp_path):
    rows = [(7, 0, "2024-03-02", "x" * 130, "a/b-12345678901234567890", 1250, 0, 8750), (7, 1, "1 Mar 2024", " pay \t roll ", None, None, 10000, 10000), (7, 2, None, None, "", 5, 0, None), (7, 3, "2024-03-02", "no amount", "", 0, 0, 8750)]
    headers = spark.createDataFrame([(7, None, "12 34", "aed", None, None, "ST-1"), (8, None, None, None, 1, 1, None)], HEADER)
    lines = files.mt940_lines(spark.createDataFrame(rows, SCHEMA).repartition(3), headers, TODAY)
    path = tmp_path / "out"
    files.write_files(lines, str(path), files.CRLF)
    expected = [
        ":20:ST1", ":25:12 34", ":28C:00001/001", ":60F:C240301AED0,00", ":61:240301C100,00NTRF", ":86:pay roll", ":61:240302D12,50NTRF//ab12345678901234", ":86:" + "x" * 65, ":86:" + "x" * 65,
        ":61:240301D0,05NTRF", ":86:BANK TRANSACTION", ":62F:C240301AED0,00",
    ]
    assert read(path) == {"7": ("\r\n".join(expected) + "\r\n").encode()}


def test_files_of_many_statements_are_whole_and_in_order(spark, tmp_path):
    df = spark.range(0, 30_000, 1, 8).select((F.col("id") % 7).alias("statement_id"), F.lit(1).alias("part"), (F.col("id") * 7919 % 30_000).alias("row_idx"), F.lit(0).alias("k"))
    df = df.unionByName(spark.range(7).selectExpr("id as statement_id", "0 as part", "0L as row_idx", "0 as k")).withColumn("line", F.concat_ws(",", "part", "row_idx"))
    files.write_files(df, str(tmp_path / "out"))
    found = read(tmp_path / "out")
    assert len(found) == 7 and all(len(list((tmp_path / "out" / f"statement_id={s}").glob("part-*"))) == 1 for s in found)
    for text in found.values():
        lines = [tuple(map(int, x.split(","))) for x in text.decode().splitlines()]
        assert lines == sorted(lines) and len(lines) > 4000
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_files(df, str(tmp_path / "out"))


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    df = spark.range(0, 1000, 1, 4).select((F.col("id") % 3).alias("statement_id"), F.lit(1).alias("part"), F.col("id").alias("row_idx"), F.lit(0).alias("k"))
    df = df.withColumn("line", F.when(F.col("row_idx") == 998, F.raise_error(F.lit("broken"))).otherwise(F.col("row_idx").cast("string")))
    with pytest.raises(Exception, match="broken"):
        files.write_files(df, str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("statement_id=*/part-*"))


def test_tally_vouchers(spark):
    rows = [(1, 0, "05/03/2024", "Tom & <b>Co</b>\n x", "R'1", 0, 500, 0), (1, 1, "2024-03-06", None, None, 250, None, 0), (1, 2, "5/3/24", "", "", 0, 0, 0)]
    lines = [r["line"].strip() for r in files.tally_lines(spark.createDataFrame(rows, SCHEMA), TODAY).orderBy("part", "row_idx", "k").collect()]
    assert lines[0].startswith("<?xml") and lines[-1] == "</ENVELOPE>" and lines.count("</VOUCHER>") == 2
    assert "<VOUCHERNUMBER>VCH-05032024-002</VOUCHERNUMBER>" in lines and "<REFERENCE>R&apos;1</REFERENCE>" in lines and "<LEDGERNAME>Tom &amp; bCo/b x</LEDGERNAME>" in lines
    amounts = [x for x in lines if x.startswith("<AMOUNT>")]
    assert amounts == ["<AMOUNT>5.00</AMOUNT>", "<AMOUNT>-5.00</AMOUNT>", "<AMOUNT>-2.50</AMOUNT>", "<AMOUNT>2.50</AMOUNT>"] and "<LEDGERNAME>Suspense</LEDGERNAME>" in lines


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert files.mt940_lines(none, spark.createDataFrame([], HEADER)).count() == 0 and files.tally_lines(none).count() == 0
    bare = files.mt940_lines(spark.createDataFrame([(1, 0, None, None, None, None, None, None)], SCHEMA), spark.createDataFrame([], HEADER), TODAY)
    assert [r["line"] for r in bare.orderBy("part", "k").collect()] == [":20:STMT1", ":25:UNKNOWN", ":28C:00001/001", ":60F:C240506INR0,00", ":62F:C240506INR0,00"]
