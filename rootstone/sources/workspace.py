"""Where stores of registered queries are kept: the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, as in local runs, below a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="rootstone-"))
        found = _own[0]
    return f"{found.rstrip('/')}/rootstone-stores/{name}-{uuid.uuid4().hex}"
