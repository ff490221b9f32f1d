"""The summary table as a log: a run's row is appended by itself, readers see each run's newest row, and many
appends are compacted into one file.

Layout: ``appends/<name>`` is one append, ``compact/<n>`` the rows of all appends that its record ``covers`` names. A
folder counts once its job has committed it (``_SUCCESS``; a compaction: its record, which is written last and never over
another). What a compaction covers is removed by the next one, so a reader that has just listed the log finds all it listed.
"""

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _names(spark: SparkSession, path: str) -> list[str]:
    fs = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(_path(spark, path))) if fs.exists(_path(spark, path)) else []


def append(df: DataFrame, path: str) -> None:
    """Add rows. Appends of several writers don't disturb each other; of a run's rows the one appended last counts.

    Columns may be new or missing, but one that the log has in another type is an error.
    """
    spark, when = df.sparkSession, time.time_ns()
    number, _, loose = _live(spark, path)
    if number or loose:
        have = spark.read.parquet(f"{path}/appends/{loose[-1]}" if loose else f"{path}/compact/{number}/rows").dtypes
        clash = sorted(c for c, kind in df.dtypes if dict(have).get(c, kind) != kind)
        if clash:
            raise ValueError(f"columns of another type than in the log: {clash}")
    name = f"{when:020d}-{uuid.uuid4().hex}"
    df.withColumns({"_when": F.lit(when), "_by": F.lit(name)}).coalesce(1).write.parquet(f"{path}/appends/{name}")  # a row a run


def _live(spark: SparkSession, path: str) -> tuple[int, set[str], list[str]]:
    """The newest compaction's number (0: none), the appends that it covers, and the committed appends beside it."""
    fs = _fs(spark, path)
    done = [int(n) for n in _names(spark, f"{path}/compact") if n.isdigit() and fs.exists(_path(spark, f"{path}/compact/{n}/record/_SUCCESS"))]
    covered = set()
    if done:
        record = spark.read.text(f"{path}/compact/{max(done)}/record", wholetext=True).first()
        covered = set(json.loads(record[0])) if record else set()
    loose = [n for n in _names(spark, f"{path}/appends") if n not in covered and fs.exists(_path(spark, f"{path}/appends/{n}/_SUCCESS"))]
    return max(done, default=0), covered, loose


def _rows(spark: SparkSession, path: str, run: str, number: int, loose: list[str]) -> DataFrame | None:
    folders = [f"{path}/compact/{number}/rows"] * bool(number) + [f"{path}/appends/{n}" for n in loose]
    if not folders:
        return None
    rows = spark.read.option("mergeSchema", "true").parquet(*folders)
    newest = rows.groupBy(run).agg(F.max_by(F.struct(*rows.columns), F.struct("_when", "_by")).alias("r"))
    return newest.select("r.*")


def read(spark: SparkSession, path: str, run: str = "config_id") -> DataFrame:
    """Each run's newest row."""
    number, _, loose = _live(spark, path)
    rows = _rows(spark, path, run, number, loose)
    if rows is None:
        raise FileNotFoundError(f"no summary at {path}")
    return rows.drop("_when", "_by")


def compact(spark: SparkSession, path: str, run: str = "config_id", files: int = 1) -> bool:
    """Write all runs' newest rows into ``files`` files; whether this call did. Of two compactions at once one gives up."""
    number, covered, loose = _live(spark, path)
    rows = _rows(spark, path, run, number, loose)
    if rows is None or not loose:
        return False
    fs, to = _fs(spark, path), f"{path}/compact/{number + 1}"
    own = f"{path}/compact/.{uuid.uuid4().hex}"
    rows.coalesce(files).write.parquet(f"{own}/rows")
    # the names that the last record covers are removed below, so they needn't be named any more
    spark.createDataFrame([(json.dumps(loose),)], "value string").coalesce(1).write.text(f"{own}/record")
    if fs.exists(_path(spark, to)) or not fs.rename(_path(spark, own), _path(spark, to)):
        fs.delete(_path(spark, own), True)
        return False
    for n in covered:
        fs.delete(_path(spark, f"{path}/appends/{n}"), True)
    if number > 1:
        fs.delete(_path(spark, f"{path}/compact/{number - 1}"), True)
    return True
