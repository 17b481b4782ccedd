"""A folder for tables a job writes and reads again."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in a folder that all executors share: ``spark.checkpoint.dir``, and in a session
    without that setting the warehouse. A warehouse on the driver's own disk is taken by local
    sessions only: on a cluster executors would not see what others wrote there."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        own_disk = urlparse(warehouse).scheme in ("", "file")
        if own_disk and not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"{warehouse}/_shared"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
