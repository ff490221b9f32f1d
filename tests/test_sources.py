"""Matrices, the summary log, and run files by tasks."""

import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.operators import conditions, evaluation
from helixmill.sources import matrices, readers, summary_log, writers


def test_matrix_values(spark, tmp_path):
    r = np.random.default_rng(3)
    made = {"a": r.random((57, 57)), "b": np.asfortranarray(r.random((40, 40)).astype(np.float32)), "c": r.integers(0, 9, (1, 1)), "d": np.zeros((0, 0)), "e": r.integers(0, 99, (130, 130)).astype(np.int16)}
    for name, m in made.items():
        np.save(tmp_path / f"{name}.npy", m)
    spark.dataSource.register(matrices.MatrixSource)
    for triangle in (True, False):
        d = spark.read.format("npy_matrix").option("triangle", str(triangle).lower()).option("values_per_partition", 500).option("values_per_batch", 70).load(str(tmp_path))
        assert d.rdd.getNumPartitions() > 15
        got = {}
        for x in d.collect():
            key = (os.path.basename(x.map_id)[0], x.i, x.j)
            assert key not in got
            got[key] = x.d
        assert got == {(n, i, j): float(m[i, j]) for n, m in made.items() for i in range(len(m)) for j in range(i + 1 if triangle else 0, len(m))}
    whole = readers.read_distance_maps(spark, str(tmp_path / "a.npy"))
    assert conditions.upper_triangle(whole).agg(F.sum("d")).first()[0] == pytest.approx(np.triu(made["a"], 1).sum())
    assert readers.read_distance_maps(spark, f"file://{tmp_path}/a.npy", triangle=True).count() == 57 * 56 // 2
    np.save(tmp_path / "f.npy", np.zeros((2, 3)))
    with pytest.raises(Exception, match="square"):
        readers.read_distance_maps(spark, str(tmp_path / "f.npy")).count()


def test_matrix_pages_of_other_rows_are_not_read(tmp_path):
    """A task of a 6000 x 6000 matrix (288 MB) adds far less than that to its memory."""
    import subprocess
    import sys

    m = np.lib.format.open_memmap(tmp_path / "m.npy", "w+", np.float64, (6000, 6000))
    m[5, 4000], m[5999, 1] = 2.5, 9.0
    m.flush()
    code = f"""
import resource
from helixmill.sources import matrices
r = matrices.MatrixReader({{"path": {str(tmp_path / 'm.npy')!r}, "values_per_partition": 1 << 20}})
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
parts = r.partitions()
total = sum(b.column("d").to_numpy().sum() for b in r.read(parts[0]))
print(len(parts), total, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 15 and float(out[1]) == 2.5 and int(out[2]) < 120_000  # kB


def test_ranges_of_rows_are_even():
    for size, values, triangle in ((1000, 5000, True), (1000, 5000, False), (7, 1, True), (1, 10, True)):
        ranges = matrices.row_ranges(size, values, triangle)
        assert [a for a, _ in ranges] == [0, *[b for _, b in ranges[:-1]]] and ranges[-1][1] == size
        held = [sum(size - 1 - i if triangle else size for i in range(a, b)) for a, b in ranges]
        assert all(h <= values or b - a == 1 for h, (a, b) in zip(held, ranges))


def files_of(path):
    return [f for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def row(spark, run, value):
    return spark.createDataFrame([(run, value, f"run-{run}.csv")], "config_id int, valid_count long, output_file string")


def test_summary_log(spark, tmp_path):
    path = str(tmp_path / "log")
    with pytest.raises(FileNotFoundError):
        readers.read_summary(spark, path)
    assert not writers.compact_summary(spark, path)
    for run in range(12):
        writers.append_summary(row(spark, run, run), path)
    writers.append_summary(row(spark, 3, 333), path)
    want = {run: run for run in range(12)} | {3: 333}
    seen = lambda: {r.config_id: r.valid_count for r in readers.read_summary(spark, path).collect()}
    assert seen() == want
    old = readers.read_summary(spark, path)  # has listed its files already
    assert writers.compact_summary(spark, path) and not writers.compact_summary(spark, path)
    assert seen() == want and old.count() == 12
    writers.append_summary(row(spark, 5, 555), path)
    assert seen() == want | {5: 555}
    assert writers.compact_summary(spark, path) and seen() == want | {5: 555}
    assert len(files_of(path)) <= 4
    os.makedirs(f"{path}/appends/never-committed")
    assert seen() == want | {5: 555}


def test_many_runs_in_few_files(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(512).select(F.col("id").cast("int").alias("config_id"), F.col("id").alias("valid_count"))
    for k in range(8):
        writers.append_summary(rows.where(f"config_id % 8 = {k}"), path)
    writers.compact_summary(spark, path)
    writers.append_summary(rows.where("config_id = 1").withColumn("valid_count", F.lit(7).cast("long")), path)
    with pytest.raises(ValueError, match="valid_count"):
        writers.append_summary(rows.withColumn("valid_count", F.lit(7)), path)
    writers.compact_summary(spark, path)
    got = {r.config_id: r.valid_count for r in readers.read_summary(spark, path).collect()}
    assert len(got) == 512 and got[1] == 7 and len(files_of(path)) <= 4


def test_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "log")
    summary_log.append(row(spark, 0, 0), path)
    done = []
    threads = [threading.Thread(target=lambda k=k: summary_log.append(row(spark, k, k), path)) for k in range(1, 5)]
    threads += [threading.Thread(target=lambda: done.append(summary_log.compact(spark, path))) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {r.config_id: r.valid_count for r in readers.read_summary(spark, path).collect()} == {k: k for k in range(5)}


def test_many_run_files_without_a_list_on_the_driver(spark, tmp_path):
    head = "# a\n# b\n" + ",".join(readers.SAMPLE_COLUMNS) + "\n"
    for k in range(300):
        (tmp_path / f"run {k}.csv").write_text(head + '"x, y",KKKKRDE,True,False,False\n' * (k % 3) + "\n")
    names = [(k, (f"file:{tmp_path}/run {k}.csv" if k % 2 else f"{tmp_path}/run {k}.csv") if k < 300 else f"{tmp_path}/missing {k}.csv") for k in range(310)]
    summary = spark.createDataFrame([*names, (999, None)], "config_id int, output_file string")
    samples = readers.read_runs(spark, summary)
    assert samples.count() == sum(k % 3 for k in range(300))
    assert samples.select("Generated Sequence").distinct().first()[0] == "x, y"
    out = {r.config_id: r.mean_charge_score for r in evaluation.attach_runs(summary, samples).collect()}
    assert len(out) == 311 and all((v is None) == (k >= 300 or k % 3 == 0) for k, v in out.items())


def test_samples_of_a_run_are_replaced(spark, tmp_path):
    path = str(tmp_path / "samples")
    writers.write_samples(spark.createDataFrame([(1, "A"), (2, "B"), (2, "C")], "config_id int, s string"), path)
    writers.write_samples(spark.createDataFrame([(2, "D")], "config_id int, s string"), path)
    assert sorted(map(tuple, spark.read.parquet(path).select("config_id", "s").collect())) == [(1, "A"), (2, "D")]


def test_a_run_of_several_files(spark, tmp_path):
    """A name may be a folder of files; what starts with _ or . there isn't the run's."""
    folder = tmp_path / "run"
    folder.mkdir()
    header = ",".join(readers.SAMPLE_COLUMNS)
    for i in range(3):
        (folder / f"part-{i}.csv").write_text(f"# head\n{header}\nx{i},ACK,True,False,False\n")
    (folder / "_SUCCESS").write_text("")
    (folder / ".part-0.csv.crc").write_text(f"{header}\nno,ACK,True,False,False\n")
    summary = spark.createDataFrame([(str(folder),), (f"file:{folder}",), (str(tmp_path / "none"),)], "output_file string")
    got = sorted((r["output_file"], r["Generated Sequence"]) for r in readers.read_runs(spark, summary).collect())
    assert got == sorted((name, f"x{i}") for name in (str(folder), f"file:{folder}") for i in range(3))
