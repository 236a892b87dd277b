"""Shared storage for intermediate tables, the folder that the session names in spark.checkpoint.dir, and small helpers for plans.

Tables written here stay until the folder is cleared: a result is read from them after the operator returns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_KEYS = 10_000
LEAST_HOT = 4096


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. Only a local session may lack the setting (tests do): its tasks and driver are one machine, and get one under /tmp."""
    # Spark 4.1 may take the partitioning of a union for granted and lose rows in a join after it
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file:///tmp/checkpoints"
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, name: str, compression: str = "zstd") -> str:
    """Write df to a new folder of the shared storage and return its path: a cut in the lineage that survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    return df.sparkSession.read.schema(df.schema).parquet(write_shared(df, name))


def text_bytes(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """(rows, bytes of the column), to size partitions."""
    n, b = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    return int(n), int(b)


def unused(name: str, *frames: DataFrame) -> str:
    """The name, with underscores after it until no column of the frames has it."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def look_up(rows: DataFrame, table: DataFrame, key: str | list[str]) -> DataFrame:
    """rows (a written table) joined with a table of one row for each key, however many rows one key has.

    Keys that hold more than a ten-thousandth of all rows (and more than LEAST_HOT) are at most HOT_KEYS many, so their
    part of the table is broadcast and their rows stay where they are; the others are joined by shuffles.
    """
    many = max(LEAST_HOT, rows.count() // HOT_KEYS)
    key = [key] if isinstance(key, str) else key
    hot = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > many).select(*key)
    apart = F.broadcast(table.join(F.broadcast(hot), key))
    rest = rows.join(F.broadcast(hot), key, "left_anti").join(table, key)
    return rows.join(apart, key).unionByName(rest)
