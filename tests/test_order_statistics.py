import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helixmill.functions.barrier import held
from helixmill.hashrand import digest, hash_rank
from helixmill.operators import conditions, corruption
from helixmill.operators import order_statistics as O


def percentile(df, col, fractions):
    return df.agg(F.expr(f"percentile({col}, array({', '.join(f'{f}d' for f in fractions)}))")).first()[0]


TENTHS = [i / 10 for i in range(11)]


def test_a_million_distinct_values_in_200_partitions(spark):
    d = spark.range(0, 1_000_000, 1, 200).select(((F.col("id") * 7919) % 1_000_003).cast("double").alias("x"))
    d = d.withColumn("x", F.col("x") * F.col("x") / 7)
    want = percentile(d, "x", TENTHS)
    for task_rows in (O.TASK_ROWS, 20_000):
        assert O.quantiles(d, "x", TENTHS, task_rows) == want


@pytest.mark.parametrize("task_rows", [3, 10**6])
@pytest.mark.parametrize("kind", ["ties", "few", "one", "odd", "skew"])
def test_values_that_repeat(spark, kind, task_rows):
    r = random.Random(4)
    values = {
        "ties": [float(r.choice([1, 1, 1, 1, 1, 2, 3])) for _ in range(600)], "few": [3.0, 1.0, 2.0], "one": [5.0],
        "odd": [None, 1.0, math.inf, -math.inf, None, 0.0, 2.0] + [r.random() for _ in range(40)], "skew": [r.random() ** 40 for _ in range(900)],
    }[kind]
    d = spark.createDataFrame([(v,) for v in values], "x double").repartition(7)
    real = sorted(v for v in values if v is not None)
    n, at = O.order_statistics(d, "x", ranks=[0, 1, len(real) // 2, len(real) - 1, len(real), -1], task_rows=task_rows)
    assert n == len(real) and at == {k: real[k] for k in (0, 1, len(real) // 2, len(real) - 1) if k < len(real)}
    if kind != "odd":
        assert O.quantiles(d, "x", TENTHS, task_rows) == percentile(d, "x", TENTHS)


def test_no_values_and_whole_numbers(spark):
    d = spark.range(100).select("id", F.lit(None).cast("double").alias("x"))
    assert O.quantiles(d, "x", TENTHS) is None and O.order_statistics(d, "x", ranks=[0]) == (0, {})
    assert O.quantiles(d, "id", [0.0, 0.5, 1.0]) == [0.0, 49.5, 99.0]
    assert {(r.bin, r.edges) for r in conditions.quantile_bin(d, "x").collect()} == {(None, None)}


def test_bins_of_edges_that_repeat(spark):
    d = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (2.0,), (None,)], "x double")
    assert sorted(((r.x, r.bin) for r in conditions.quantile_bin(d, "x", 4, "drop").collect()), key=str) == [(1.0, 0)] * 3 + [(2.0, 1), (None, None)]
    with pytest.raises(ValueError, match="unique"):
        conditions.quantile_bin(d, "x", 4)


def test_one_batch_of_a_million_rows_is_spread(spark):
    d = spark.range(0, 1_000_000, 1, 16).select((F.col("id") * 7919 % 1_000_003).alias("id"), F.lit(1).alias("batch"))
    out = corruption.stratified_t(d, "batch", "id", 3)
    i = F.row_number().over(Window.orderBy("id")) - 1
    from helixmill.hashrand import uniform

    want = d.withColumn("t2", (uniform(3, "id") / 1e6 + i / 1e6) % 1 * (1 - 1e-3) + 1e-3)
    assert out.join(want, "id").where(F.abs(F.col("t") - F.col("t2")) > 1e-12).count() == 0 and out.count() == 1_000_000
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    ranks = O.ranked(d, ["id"], "batch")
    sizes = [r["count"] for r in ranks.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 900_000


def test_ranks_within_groups_and_ties(spark):
    r = random.Random(6)
    rows = [(r.choice(["hot"] * 8 + ["a", "b", None]), r.randint(0, 300), k) for k in range(2000)]
    d = spark.createDataFrame(rows, "g string, id int, k int").repartition(9)
    for within in ("g", None):
        out = O.ranked(d, ["id", "k"], within, "r", "n").collect()
        by = {}
        for x in sorted(out, key=lambda x: (x.id, x.k)):
            key = x.g if within else 0
            assert x.r == by.setdefault(key, 0)
            by[key] += 1
        assert all(x.n == by[x.g if within else 0] for x in out) and len(out) == 2000
    tied = sorted(x.rank for x in O.ranked(d, ["id"]).collect())
    assert tied == list(range(2000))
    assert O.ranked(d.limit(0), ["id"], "g").collect() == []


@pytest.mark.parametrize("range_rows", [1, 60, 50_000])
def test_hash_ranks_with_any_number_of_ranges(spark, range_rows):
    d = spark.range(3000).select("id", (F.col("id") % 3).alias("g"))
    for within in (None, "g"):
        keys = [within, "id"] if within else ["id"]
        by = Window.partitionBy(*keys[:-1]).orderBy(digest("s", *keys), "id")
        want = {x.id: x.r - 1 for x in held(d).withColumn("r", F.row_number().over(by)).collect()}
        assert {x.id: x["rank"] for x in hash_rank(d, "s", "id", within, range_rows).collect()} == want


def test_dictionary_has_the_last_edge(spark, tmp_path):
    from helixmill.sources import writers

    maps = spark.createDataFrame([("m", i, j, float(abs(i - j))) for i in range(6) for j in range(6)], "map_id string, i int, j int, d double")
    words, ids = conditions.distance_dictionary(maps, 4), conditions.distance_bins(maps, 4)
    edges = [r.edge for r in words.orderBy("bin_id").collect()]
    assert edges == [0.0, *sorted(set(percentile(maps.where("i < j"), "d", [0, 0.25, 0.5, 0.75, 1])))]
    assert [(r.bin_id, r.edge, r.special) for r in ids.orderBy("bin_id").collect()] == [(i, e, None) for i, e in enumerate(edges[:-1])] + [
        (len(edges) - 1 + k, None, s) for k, s in enumerate(conditions.SPECIALS)
    ]
    writers.write_bins(words, str(tmp_path / "bins"))
    for name, want in (("dictionary", [(str(i), str(e)) for i, e in enumerate(edges)]), ("ids", [(str(e), str(i)) for i, e in enumerate(edges[:-1])] + [(f"<{s}>", str(len(edges) - 1 + k)) for k, s in enumerate(conditions.SPECIALS)])):
        assert sorted(map(tuple, spark.read.csv(str(tmp_path / "bins" / name)).collect())) == sorted(want)
    with pytest.raises(Exception, match="exists"):
        writers.write_bins(words, str(tmp_path / "bins"))
