"""Sinks. None rewrites its input; runs are partitions that can be written again."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.sources import summary_log


def write_samples(df: DataFrame, path: str, run: str = "config_id") -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)


def append_summary(df: DataFrame, path: str) -> None:
    """A run's summary row; writing the run again replaces it for ``readers.read_summary``."""
    summary_log.append(df, path)


def compact_summary(spark: SparkSession, path: str, run: str = "config_id") -> bool:
    """Many runs' rows into one file; whether there was anything to do."""
    return summary_log.compact(spark, path, run)


def write_scored(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def write_frequencies(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_bins(dictionary: DataFrame, path: str) -> None:
    """Both tables of a distance dictionary, without headers: ``dictionary`` (bin, edge) with all edges, ``ids`` (edge or <token>, id)."""
    from helixmill.operators.conditions import distance_ids

    ids = distance_ids(dictionary).select(F.coalesce(F.col("edge").cast("string"), F.concat(F.lit("<"), "special", F.lit(">"))).alias("token"), "bin_id")
    for name, rows in (("dictionary", dictionary.select("bin_id", "edge")), ("ids", ids)):
        rows.coalesce(1).sortWithinPartitions("bin_id").write.mode("errorifexists").csv(f"{path}/{name}")  # a row an edge


def write_vocab(vocab: DataFrame, path: str) -> bool:
    """Write unless the path is there; whether it was written."""
    spark = vocab.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return False
    vocab.select(F.concat_ws(",", "token", "token_id")).write.text(path)
    return True
