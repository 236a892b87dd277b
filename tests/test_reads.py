"""Operators of several steps compute what they are given once, however often the steps read it."""

from pyspark.sql import functions as F

from ledgerlark.operators import layout, lines, matching, tables


def counted(df):
    """df, and how many of its rows were computed so far."""
    total = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            total.add(len(batch))
            yield batch

    return df.mapInArrow(run, df.schema), total


def test_lines_are_read_once(spark):
    text = "concat('0', id % 9 + 1, '/02/2024 shop ', id, ' 5.00 - 9.00')"
    df, total = counted(spark.range(40).selectExpr("id % 2 AS statement_id", "id div 2 AS row_idx", f"{text} AS line"))
    assert lines.assemble_rows(df, block=4).count() == 40 and total.value == 40


def test_lines_of_tables_are_read_once(spark):
    text = "CASE id div 2 WHEN 0 THEN '| Date | Note | Balance |' WHEN 1 THEN '|---|---|---|' ELSE '| 01/02/2024 | shop | 5.00 |' END"
    df, total = counted(spark.range(40).selectExpr("id % 2 AS statement_id", "id div 2 AS row_idx", f"{text} AS line"))
    assert tables.table_rows(df, block=4).count() == 36 and total.value == 40


def test_tokens_are_read_once(spark):
    df, total = counted(spark.range(60).selectExpr("id % 2 AS statement_id", "1 AS page", "100.0D * (id div 2 % 3) AS x", "800.0D - 12 * (id div 6) AS y", "concat(id, '.00') AS text"))
    placed = layout.group_lines(df)
    found = layout.anchored_amounts(placed, layout.detect_layout(placed))
    assert found.count() == 20 and total.value == 60
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # lines and layouts are read, not made again


def test_extractions_are_read_once(spark):
    rows = spark.range(40).selectExpr("id % 2 AS statement_id", "id div 2 AS row_idx", "'2024-02-01' AS date", "concat('shop ', id) AS description", "'' AS ref_number", "id AS debit", "0L AS credit", "id * 1000 AS balance")
    (first, n), (second, m) = counted(rows), counted(rows.withColumn("description", F.lit("x")))
    assert matching.merge_extractions(first, second).count() == 40 and (n.value, m.value) == (40, 40)
