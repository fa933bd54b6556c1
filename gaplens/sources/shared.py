"""Tables in the folder that driver and executors share: lineage ends there, and a lost executor costs a reread."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a local folder only where it is unset and the session runs in one process, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not re.fullmatch(r"local(\[[^,]*(,\d+)?\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    where = f"file://{tempfile.gettempdir()}/gaplens-tables"
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def settled(df: DataFrame) -> DataFrame:
    """Written once and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gaplens-{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").parquet(path)
    if not _written:
        atexit.register(sweep)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def sweep() -> None:
    """Delete all written tables; call it before the session ends."""
    while _written:
        spark, path = _written.pop()
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may have ended already
            continue
