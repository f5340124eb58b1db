"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one if all work is done in this process, else an error."""
    where, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not where and not re.fullmatch(r"local(\[[^\]]*\])?", app.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not where:
        where = _own.get(app.applicationId) or "file://" + tempfile.mkdtemp(prefix="lexloom-")
        _own[app.applicationId] = where
    return where.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """For queries and stages, not operators: hand rows to Python workers in batches of so many at most, which bounds memory where texts are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now > rows or now <= 0:
        spark.conf.set(name, str(rows))


class Scratch:
    """Written intermediate tables of one run."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base, self.n = spark, f"{shared_folder(spark)}/lexloom-{name}-{uuid.uuid4().hex}", 0
        self.paths: set[str] = set()

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        self.paths.add(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lexloom_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        self._delete({df._lexloom_path})

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        self._delete(self.paths - {df._lexloom_path for df in tables})

    def _delete(self, paths: set[str]) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
        self.paths -= paths


def extended(df: DataFrame, columns: list[str], ddl: str) -> StructType:
    """The schema of df's columns with those of ddl after them."""
    return StructType([*df.select(*columns).schema.fields, *StructType.fromDDL(ddl).fields])
