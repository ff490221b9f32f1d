import random

import pytest
from pyspark.sql import functions as F

from helixmill.operators import evaluation, membership


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "payload string")


def test_added_keys_pass_and_few_others(spark):
    r = random.Random(1)
    words = [f"K{r.random()}" for _ in range(6000)]
    inside, outside = words[:3000], words[3000:]
    shape = membership.shape_for(3000, 0.01)
    sketch = membership.build(keys(spark, inside + [None]), "payload", shape)
    hit = lambda v: membership.probe(keys(spark, v), "payload", sketch, "maybe").where("maybe").count()
    assert hit(inside) == 3000 and hit([None]) == 0
    share = hit(outside) / 3000
    assert share < 0.02 and abs(membership.error_of(sketch) - membership.expected_error(3000, shape)) < 0.004


def test_merge_is_the_sketch_of_both(spark, tmp_path):
    a, b = [f"A{i}" for i in range(50)], [f"B{i}" for i in range(70)]
    for log_blocks in (0, 5):
        one = membership.merge(membership.build(keys(spark, a), "payload", log_blocks), membership.build(keys(spark, b), "payload", log_blocks))
        membership.save(one, str(tmp_path / f"s{log_blocks}"))
        both = membership.build(keys(spark, a + b), "payload", log_blocks)
        assert sorted(map(tuple, membership.load(spark, str(tmp_path / f"s{log_blocks}")).collect())) == sorted(map(tuple, both.collect()))
    mixed = membership.merge(membership.build(keys(spark, a), "payload", 1), membership.build(keys(spark, b), "payload", 2))
    with pytest.raises(ValueError):
        membership.shape_of(mixed)
    with pytest.raises(ValueError):
        membership.build(keys(spark, a), "payload", membership.LARGEST + 1)


@pytest.mark.parametrize("log_blocks, crowd", [(12, 0), (0, 3000), (0, 0)])
def test_answers_are_those_of_the_join(spark, log_blocks, crowd):
    """With one block that 3000 keys fill, every payload passes the sketch in error; the join still decides."""
    training = keys(spark, [f"AC{'K' * i}" for i in range(1, 30)])
    rows = [(i, f"AC{'K' * (i % 50)}" if i % 3 else None, i % 3 > 0 and i % 7 > 0) for i in range(300)]
    samples = spark.createDataFrame(rows, "i int, payload string, is_valid boolean")
    sketch = membership.build(training.union(keys(spark, [f"x{i}" for i in range(crowd)])), "payload", log_blocks)
    want = sorted(map(tuple, evaluation.flag_known(samples, training).select("i", "payload", "is_valid", "known").collect()), key=str)
    got = evaluation.flag_known(samples, training, sketch)
    assert sorted(map(tuple, got.select("i", "payload", "is_valid", "known").collect()), key=str) == want
    sent = membership.probe(samples.where("is_valid"), "payload", sketch, "maybe").where("maybe").count()
    valid = samples.where("is_valid").count()
    known = sum(w[3] for w in want)
    assert sent == valid if crowd else known <= sent < valid if log_blocks else True


def test_sketch_of_nothing(spark):
    none = membership.build(keys(spark, []), "payload", 3)
    assert membership.probe(keys(spark, ["A", None]), "payload", none, "maybe").where("maybe").count() == 0
    assert membership.error_of(none) == 0.0 and membership.shape_for(0) == 0


def test_rows_sent_to_the_join_fall(spark):
    """Of 1000 novel and 20 known payloads, the join's left side reads the known ones and a few more."""
    training = keys(spark, [f"A{i}" for i in range(20)]).withColumn("payload", F.col("payload"))
    samples = keys(spark, [f"A{i}" for i in range(1020)]).withColumn("is_valid", F.lit(True))
    sketch = membership.build(training, "payload", membership.shape_for(20, 0.01))
    assert membership.probe(samples, "payload", sketch, "maybe").where("maybe").count() < 60
