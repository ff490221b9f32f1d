import hashlib
import random

import numpy as np
import pytest

import oracle
from helixmill.llm import exact_dedup as X

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, digest string, run long, `to` int"


def made(n=400):
    r = random.Random(3)
    texts = [None, "", " ", "a", "A", "a ", "é", "z" * 50_000] + [f"text {i}" for i in range(60)]
    rows = [(r.choice([None, *range(300)]), r.choice(texts[:4] if r.random() < 0.4 else texts), "x", 1, i) for i in range(n)]
    return rows + rows[:25]  # rows that repeat


def brute(rows, keep, norm=lambda t: t):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t or ""), []).append(i)
    pick = max if keep == "largest" else min
    out = []
    for t, ids in groups.items():
        some = [i for i in ids if i is not None]
        best = pick(some) if some else None
        stay = ids.index(best)
        out += [(i, best, len(ids), k == stay, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=str)


@pytest.mark.parametrize("keep, fan, run_rows, parts", [("largest", 8, 1 << 18, 4), ("largest", 2, 7, 9), ("smallest", 2, 50, 3)])
def test_all_rows_against_brute_force(spark, keep, fan, run_rows, parts):
    rows = made()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in X.copy_groups(docs, keep, fan=fan, run_rows=run_rows).collect()]
    assert sorted(got, key=str) == brute(rows, keep)


def test_normalised_texts(spark):
    from pyspark.sql import functions as F

    rows = made()
    got = X.copy_groups(spark.createDataFrame(rows, SCHEMA), normalise=lambda c: F.lower(F.trim(c))).collect()
    want = brute(rows, "largest", lambda t: t.strip(" ").lower())
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in got), key=str) == want


def test_one_row_of_each_text_stays(spark):
    rows = made()
    docs = spark.createDataFrame(rows, SCHEMA)
    left = X.drop_copies(docs)
    assert left.columns == docs.columns
    got = [(r.doc_id, r.text or "") for r in left.collect()]
    assert len(got) == len({t for _, t in got})
    assert sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in got if i is not None) == sorted((a, h) for a, _, _, k, h in brute(rows, "largest") if k and a is not None)


def test_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert X.copy_groups(docs).collect() == [] and X.drop_copies(docs).collect() == []


def test_digests_are_compared_whole():
    """Digests that share 8, 16 or 24 bytes stay apart, whatever order their runs come in."""
    head = np.arange(32, dtype=np.uint8)
    others = [np.concatenate([head[:n], head[n:] + 1]).astype(np.uint8) for n in (8, 16, 24)]
    digests = np.stack([head, others[0], head, *others, others[2]])
    one = np.ones(len(digests), np.int64)
    order, group, starts, kept, counts = X.merge_runs(X.words(digests), one.astype(np.uint8), np.arange(len(digests)), one)
    assert len(starts) == 4 and sorted(counts.tolist()) == [1, 2, 2, 2]
    assert {digests[k].tobytes() for k in kept} == {d.tobytes() for d in digests}
    assert all(digests[a].tobytes() == digests[b].tobytes() for a, b in zip(kept, order[starts]))


def test_tree_holds_the_width():
    for width in (1, 2, 3, 8, 9, 51, 64, 65, 211, 1000, 20_000):
        fan, rounds = X.tree_shape(width)
        assert width <= fan**rounds and 2 <= fan <= 8 and (fan == 2 or (fan - 1) ** rounds < width)


def test_sql(spark):
    oracle.compare(X.query(spark, SF), oracle.connect(SF), X.ORACLE_SQL)
