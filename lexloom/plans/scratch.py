"""A folder for files that a query writes and reads again: under the one that executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


_own: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset, under a temporary folder if all work is done in this process, else an error."""
    where, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not where and not re.fullmatch(r"local(\[[^\]]*\])?", app.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not where:
        where = _own.setdefault(app.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="lexloom-")
        _own[app.applicationId] = where
    return f"{where.rstrip('/')}/lexloom-{name}-{uuid.uuid4().hex}"
