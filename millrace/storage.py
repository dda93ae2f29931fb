"""Where tables, streams and intermediate results lie."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_base(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines see; where none is set, a temporary one for a local master, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    return folder or tempfile.mkdtemp(prefix="millrace-")


def shared_root(spark: SparkSession, name: str) -> str:
    """A new folder that all machines see."""
    return f"{shared_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
