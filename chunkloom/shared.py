"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a session on one machine gets a temporary folder;
    on a cluster it is an error."""
    try:
        where = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # noqa: BLE001 - a missing setting raises in some sessions
        where = None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="chunkloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")
