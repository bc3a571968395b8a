"""Where queries put tables that they read again: the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local master without that setting gets a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, _own.get(app) or tempfile.mkdtemp(prefix="marlstone-"))
    return f"{base.rstrip('/')}/marlstone/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
