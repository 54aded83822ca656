"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that is still broadcast, and of a part of a small table.
SENT, PART_ROWS = 2_000_000, 100_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local folder only where none is set, as in tests."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if not folder:
        folder = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="docsift-")
    if not current.isDefined():
        context.setCheckpointDir(folder)
    return folder


def persisted(df: DataFrame) -> DataFrame:
    """The same rows, computed now and read from the shared folder from here on."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def few(df: DataFrame, most: int = SENT) -> DataFrame:
    """The same rows of a persisted table, broadcast if they aren't too many: Spark doesn't know the size of such a table."""
    return F.broadcast(df) if df.count() <= most else df


def in_parts(df: DataFrame, rows: int) -> DataFrame:
    """The same rows, so many, in no more parts than they need: every part of every exchange is three files."""
    return df.coalesce(max(1, -(-rows // PART_ROWS)))
