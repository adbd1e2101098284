"""Databases for one query's use, in the folder that the session's machines share."""

from __future__ import annotations

import getpass
import tempfile
import uuid

from pyspark.sql import SparkSession

from fernstore.sources.database import Database


def scratch_database(spark: SparkSession, strict: bool = False) -> Database:
    """A new, empty database under ``spark.checkpoint.dir``; a local session without it uses a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master  # local-cluster has executors of its own
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/fernstore-{getpass.getuser()}"
    return Database(spark, f"{base.rstrip('/')}/db-{uuid.uuid4().hex}", strict)
