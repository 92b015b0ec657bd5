"""Folders for what a run writes on its way, where the driver and all executors see them."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def run_folder(spark: SparkSession, kind: str) -> str:
    """The path of a new folder below the session's checkpoint folder.

    Where that setting is empty, a local master may use a temporary folder; on a cluster nothing is shared then, so that is an error.
    """
    base = spark.conf.get(SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="larder-")
        spark.conf.set(SETTING, base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{kind}-{uuid4().hex}"
