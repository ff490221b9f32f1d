import os

import numpy as np
import pytest

from helixmill.llm import common as C
from helixmill.llm import training_order as T


def test_ids_that_do_not_fit_are_errors(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    with pytest.raises(Exception, match="doesn't fit"):
        T.sequences(docs, 16, end_id=70_000).collect()
    with pytest.raises(Exception, match="doesn't fit"):
        T.sequences(docs, 16, pad_id=70_000).collect()
    row = T.sequences(docs, 16, end_id=70_000, pad_id=70_001, id_bytes=4).collect()[0]
    assert np.frombuffer(row.ids, np.uint32)[row.n_tokens - 1 :].tolist() == [70_000] + [70_001] * (16 - row.n_tokens)


@pytest.mark.parametrize("per_shard", [1, 4, 1000])
def test_a_partition_a_shard(spark, tmp_path, per_shard):
    """Every slot once, at its place in its shard's file; a partition writes one file; null columns and clashing names pass."""
    docs = spark.createDataFrame([(i if i % 5 else None, "w " * (i % 7 * 9), None, 1) for i in range(60)], "doc_id long, text string, ids binary, place int")
    seqs = C.materialize(T.sequences(docs, 8), "sequences-test")
    rows = T.write_shards(T.in_training_order(seqs, 7), f"file://{tmp_path}/s", 8, per_shard)
    assert rows.rdd.getNumPartitions() == -(-seqs.count() // per_shard)
    got = C.materialize(rows, "shards-test").collect()
    n = seqs.count()
    assert sorted(r.slot for r in got) == list(range(n))
    assert sorted(os.listdir(tmp_path / "s")) == [f"shard-{k:06d}.bin" for k in range(-(-n // per_shard))]
    assert all(r.shard == r.slot // per_shard and r.byte_offset == r.slot % per_shard * 16 for r in got)
    order = {r.slot: bytes(r.ids) for r in T.in_training_order(seqs, 7).collect()}
    assert [x.tobytes() for x in T.read_shards(f"file://{tmp_path}/s", 0, n, 8, per_shard)] == [order[k] for k in range(n)]
    # a brute-force slot table
    base = sorted((r.part, r.place) for r in seqs.collect())
    slots = T.feistel(np.arange(n), n, 7)
    assert {(r.part, r.place): r.slot for r in T.in_training_order(seqs, 7).collect()} == dict(zip(base, slots.tolist()))
    assert sorted(slots.tolist()) == list(range(n))


def test_no_rows(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert T.write_shards(T.in_training_order(T.sequences(none)), f"file://{tmp_path}/s").collect() == []
