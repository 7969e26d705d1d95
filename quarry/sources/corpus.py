"""Source files as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import dirname, lines
from quarry.operators.files import NEVER, excluded


def files(spark: SparkSession, root: str, endings: tuple[str, ...] = (), exclusions: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """(path, content) of the files below a root that have one of the endings (any, if none are given) and that no exclusion names.

    Paths are relative to the root. Folders that are never scanned are left out by path, before
    contents are read; files larger than a limit, in bytes, are left out as well if one is given. Bytes
    that are not UTF-8 are replaced.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if limit is not None:
        rows = rows.filter(F.col("length") <= limit)
    whole = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = whole.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(whole).toString().rstrip("/")
    rows = rows.withColumn("path", F.regexp_replace("path", "^" + literal(base) + "/", ""))
    if endings:
        keep = F.lit(False)
        for e in endings:
            keep = keep | F.col("path").endswith(e)
        rows = rows.filter(keep)
    return rows.filter(~excluded(F.col("path"), (*NEVER, *exclusions))).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def literal(text: str) -> str:
    return r"\Q" + text.replace("\\E", r"\E\\E\Q") + r"\E"


def metrics(found: DataFrame) -> DataFrame:
    """One row: files, lines and folders of a corpus."""
    return found.agg(F.count("*").alias("files"), F.sum(F.size(lines("content"))).alias("loc"), F.countDistinct(dirname("path")).alias("folders"))
