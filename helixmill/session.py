"""Where intermediate tables go."""

import tempfile
import uuid

from pyspark.sql import SparkSession


_LOCAL: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; in local mode, where that is unset, in one local folder of this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(f"file://{tempfile.mkdtemp(prefix='spark-')}")
        root = _LOCAL[0]
    return f"{root}/helixmill-{uuid.uuid4().hex}/{name}"
