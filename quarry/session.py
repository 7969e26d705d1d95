"""Spark sessions with the settings that results depend on."""

from __future__ import annotations

import re
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def session(name: str = "quarry", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf entries are added, with dots as double underscores."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept in the folder that all executors share, with its lineage cut."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="quarry-"))
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys to four tasks a core, for costly work on rows that a few files hold: a file of some MB is one task otherwise."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few given rows that the planner has at hand, with no job to make it."""
    names = [c.split()[0] for c in re.split(r",\s*(?=\w+ \w)", schema)]
    if not rows:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in rows]), schema)
