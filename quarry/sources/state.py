"""The findings of a project between scans, as numbered tables in a folder that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schema


class InvalidState(ValueError):
    """A state that breaks a rule of findings."""


def faults(findings: DataFrame) -> DataFrame:
    """(id, fault): rows that break a rule: an id missing or repeated, an unknown status, a tier beyond 1 to 4, reopenings below none."""
    repeated = findings.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("repeated id").alias("fault"))
    fault = (
        F.when(F.col("id").isNull() | (F.col("id") == ""), "no id")
        .when(~F.coalesce(F.col("status").isin(*schema.STATUSES), F.lit(False)), "unknown status")
        .when(~F.coalesce(F.col("tier").between(1, 4), F.lit(False)), "tier beyond 1 to 4")
        .when(F.col("reopen_count") < 0, "reopened less than never")
    )
    return repeated.unionByName(findings.select("id", fault.alias("fault")).filter("fault is not null"))


class Store:
    """Versions of a findings table. A version counts once Spark has committed it, so a write that fails leaves the last one in place."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path)]
        done = [p for p in names if p.getName().startswith("v") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in done if p.getName()[1:].isdigit())

    def load(self, version: int | None = None) -> DataFrame | None:
        """The last version, or a given one; none where nothing is stored."""
        known = self.versions()
        if not known:
            return None
        return self.spark.read.parquet(f"{self.folder}/v{known[-1] if version is None else version}")

    def save(self, findings: DataFrame) -> int:
        """Write the next version; InvalidState where rows break a rule."""
        if bad := faults(findings).limit(5).collect():
            raise InvalidState("; ".join(f"{r['id']}: {r['fault']}" for r in bad))
        number = (self.versions() or [0])[-1] + 1
        findings.write.mode("overwrite").parquet(f"{self.folder}/v{number}")
        return number
