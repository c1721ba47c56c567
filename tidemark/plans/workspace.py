"""Folders for checkpoints and written results."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared one that the session names in ``spark.checkpoint.dir``.

    What is written there stays until it is removed, since results may still be read
    from it. Where the setting is missing, a session whose driver and executors are one
    process gets a temporary folder, removed at its end; for any other this is an error.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not _one_process(spark):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/tidemark/{purpose}-{uuid.uuid4().hex}"


def _one_process(spark: SparkSession) -> bool:
    try:
        master = spark.sparkContext.master
    except PySparkException:
        return False
    return master == "local" or master.startswith("local[")


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder
