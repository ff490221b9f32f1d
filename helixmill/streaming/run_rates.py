"""Running rates while sample files arrive.

State: the first-seen payloads of each run, kept by Spark's own deduplication, exact and so without expiry. A
task first folds the rows it has into a row a run with their counts, under a key of its own, and a row a distinct
valid payload, keyed by run and payload; deduplication lets the former pass and the latter once. So one query, with one
checkpoint, yields each micro-batch's increments, and no payload's count is ever read again.

Totals are a row a run. Each micro-batch writes them anew from those of the batch before, under its own number, so a batch
that is repeated after a failure writes the same totals again.
"""

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators.evaluation import flagged, ratio
from helixmill.session import scratch

TOTALS = ["total_samples", "valid_count", "novel_count", "unique_count"]


def rates_of(totals: DataFrame, run: str = "config_id") -> DataFrame:
    """The rates of each run, from its totals."""
    c = F.col
    return totals.select(run, *TOTALS).withColumn("repeat_count", c("valid_count") - c("unique_count")).withColumns(
        {"success_rate": ratio(c("valid_count"), c("total_samples")), "novelty_rate": ratio(c("novel_count"), c("total_samples")), "repeat_rate": ratio(c("repeat_count"), c("valid_count"))}
    )


def _fold(run: str):
    """mapInArrow function from (run, payload, is_valid, known) to the rows that are deduplicated."""

    def out(runs, keys, *counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([runs, pa.array(keys, pa.string()), *[pa.array(c, pa.int64()) for c in counts]], names=[run, "key", *TOTALS])

    def fold(batches):
        for b in batches:
            rows = pa.Table.from_batches([b]).group_by([run, "payload", "is_valid", "known"]).aggregate([([], "count_all")])
            n, valid, known = rows["count_all"].to_numpy(), rows["is_valid"].to_numpy().astype(bool), rows["known"].to_numpy().astype(bool)
            counts = pa.table({run: rows[run], "t": pa.array(n), "v": pa.array(n * valid), "n": pa.array(n * (valid & ~known))})
            counts = counts.group_by([run]).aggregate([("t", "sum"), ("v", "sum"), ("n", "sum")])
            mark = uuid.uuid4().hex
            zero = [0] * counts.num_rows
            yield out(counts[run].combine_chunks(), [f"a{mark}:{i}" for i in range(counts.num_rows)], counts["t_sum"].to_pylist(), counts["v_sum"].to_pylist(), counts["n_sum"].to_pylist(), zero)
            seen = rows.filter(pa.array(valid))
            names = ["n" if r is None else f"r{len(str(r))}:{r}" for r in seen[run].to_pylist()]
            none, one = [0] * seen.num_rows, [1] * seen.num_rows
            yield out(seen[run].combine_chunks(), [f"p{r}:{p}" for r, p in zip(names, seen["payload"].to_pylist())], none, none, none, one)

    return fold


def _add(spark: SparkSession, increments: DataFrame, number: int, out: str, run: str) -> None:
    """Totals after batch ``number``: those after the one before, if there was one, and what this one brings."""
    rows = increments.select(run, *TOTALS)
    if number:
        rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{out}/{number - 1}"))
    rows.groupBy(run).agg(*[F.sum(c).alias(c) for c in TOTALS]).coalesce(1).write.mode("overwrite").parquet(f"{out}/{number}")
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{number - 2}")
    old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def _newest(spark: SparkSession, out: str) -> str | None:
    """The totals' folder of the last batch. There are two folders at most."""
    root = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    numbers = [int(f.getPath().getName()) for f in fs.listStatus(root)] if fs.exists(root) else []
    done = [n for n in numbers if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{n}/_SUCCESS"))]
    return f"{out}/{max(done)}" if done else None


def stream_run_rates(spark: SparkSession, samples: DataFrame, training: DataFrame, run: str = "config_id", at: str | None = None, sketch: DataFrame | None = None) -> DataFrame:
    """Drain the stream ``samples`` (run, generated_sequence) and return the rates of each run, of all that ever arrived.

    ``at``: a folder that all executors share, for the checkpoint and the totals; a later call with the same folder goes on
    from there, also after a failure. By default a new one. ``sketch``: as in ``evaluation.flag_known``.
    """
    at = at or scratch(spark, "stream")
    rows = flagged(samples.select(run, "generated_sequence"), training, sketch).select(run, "payload", "is_valid", "known")
    kind = samples.schema[run].dataType.simpleString()
    schema = f"`{run}` {kind}, key string, " + ", ".join(f"{c} long" for c in TOTALS)
    fresh = rows.mapInArrow(_fold(run), schema).dropDuplicates(["key"])
    query = (
        fresh.writeStream.outputMode("append").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
        .foreachBatch(lambda df, number: _add(df.sparkSession, df, number, f"{at}/totals", run)).start()
    )
    query.awaitTermination()
    newest = _newest(spark, f"{at}/totals")
    schema = f"`{run}` {kind}, " + ", ".join(f"{c} long" for c in TOTALS)
    return rates_of(spark.read.schema(schema).parquet(newest) if newest else spark.createDataFrame([], schema), run)
