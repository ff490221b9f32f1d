"""Streaming rates over several micro-batches, a restart and a failure, against the batch query."""

import random

import pytest

from helixmill.operators import evaluation, membership
from helixmill.streaming import run_rates as R

SCHEMA = "config_id int, sample_id int, generated_sequence string"


def made(n=600):
    r = random.Random(11)
    pool = [f"<SOS>{''.join(r.choice('ACDKR') for _ in range(r.choice([2, 3, 9])))}<EOS>" for _ in range(60)] + ["not valid!", "", None]
    return [(r.choice([None, 1, 1, 1, 1, 2, 30]), i, r.choice(pool)) for i in range(n)]


@pytest.fixture
def world(spark, tmp_path):
    rows = made()
    training = spark.createDataFrame([("AC",), ("KR",), ("D" * 9,)], "payload string")
    parts = [spark.createDataFrame(rows[i::5], SCHEMA) for i in range(5)]

    def arrive(*which):
        for i in which:
            parts[i].coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def stream():
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def batch(*which):
        d = parts[which[0]]
        for i in which[1:]:
            d = d.union(parts[i])
        return sorted(map(tuple, evaluation.run_rates(evaluation.by_payload(d, training)).drop("novelty_of_valid").collect()), key=str)

    return training, arrive, stream, batch, str(tmp_path / "at")


def rates(df):
    order = ["config_id", "total_samples", "valid_count", "novel_count", "unique_count", "repeat_count", "success_rate", "novelty_rate", "repeat_rate"]
    return sorted(map(tuple, df.select(*order).collect()), key=str)


def test_five_batches_and_a_restart(spark, world):
    training, arrive, stream, batch, at = world
    arrive(0, 1)
    assert rates(R.stream_run_rates(spark, stream(), training, at=at)) == batch(0, 1)
    arrive(2, 3, 4)  # payloads seen before the restart are repeats after it
    assert rates(R.stream_run_rates(spark, stream(), training, at=at)) == batch(0, 1, 2, 3, 4)
    assert rates(R.stream_run_rates(spark, stream(), training, at=at)) == batch(0, 1, 2, 3, 4)  # nothing new


def test_a_batch_that_fails_after_its_totals_are_written(spark, world, monkeypatch):
    training, arrive, stream, batch, at = world
    arrive(0, 1, 2, 3, 4)
    add = R._add

    def breaks(spark_, increments, number, out, run):
        add(spark_, increments, number, out, run)
        if number == 2:
            raise RuntimeError("lost before the commit")

    monkeypatch.setattr(R, "_add", breaks)
    with pytest.raises(Exception, match="lost before the commit"):
        R.stream_run_rates(spark, stream(), training, at=at)
    monkeypatch.setattr(R, "_add", add)
    assert rates(R.stream_run_rates(spark, stream(), training, at=at)) == batch(0, 1, 2, 3, 4)


def test_with_a_sketch_of_the_training_set(spark, world):
    training, arrive, stream, batch, at = world
    arrive(3, 1)
    sketch = membership.build(training, "payload", 2)
    assert rates(R.stream_run_rates(spark, stream(), training, at=at, sketch=sketch)) == batch(3, 1)


def test_no_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    none = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    assert R.stream_run_rates(spark, none, spark.createDataFrame([], "payload string"), at=str(tmp_path / "at")).collect() == []
