"""Tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_placed: list[str] = []


def place(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; in a local folder only where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _placed.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to a new place and read again."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folders: set[str]) -> None:
    """Deletes those of this session's tables that lie in the folders of these names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in [p for p in _placed if p.rsplit("/", 1)[1] in folders]:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        _placed.remove(p)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this session has placed. Results that read them must have been written by then."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _placed:
        path = jvm.org.apache.hadoop.fs.Path(_placed.pop())
        path.getFileSystem(conf).delete(path, True)
