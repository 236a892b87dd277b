"""Tables that an operator reads several times, written once to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def plain_unions(spark: SparkSession) -> None:
    """Spark 4.1 may take the partitioning of a union for granted and lose rows in a join after it; this session setting keeps it from that."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. A local session may lack it: it gets a new temporary folder, removed at exit."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _own[app], True)
    return f"file://{_own[app]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back: computed once, and not again if executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
