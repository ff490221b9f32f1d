import math
import random

import pytest

import oracle
from helixmill.llm import benchmark_leaks, vector_topk

SF = "/root/testdata/sf0.001"


def test_topk_small(spark):
    r = random.Random(1)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)], "x") for i in range(700)]
    rows += [(700, None, "x"), (701, [1.0] * 5 + [float("nan")], "x"), (702, [None] + [1.0] * 5, "x"), (703, [float("inf")] * 6, "x"), (None, [1.0] * 6, "x"), (800, rows[3][1], "x"), (801, rows[3][1], "x"), rows[5]]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    good = [(i, [math.floor(1024 * y) for y in x]) for i, x, _ in rows if i is not None and x and all(y is not None and math.isfinite(y) for y in x)]
    want = []
    for q, x in good:
        if q % 100 == 0:
            hits = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in good if i != q)[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(hits)]
    for size in (512, 16):
        got = vector_topk.top_k(v, v.where("vec_id % 100 = 0"), candidates_per_block=size, queries_per_block=3).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert vector_topk.top_k(v.limit(0), v.limit(0)).collect() == []
    big = spark.createDataFrame([(0, [1e8, 3.0]), (1, [1e3, 1.0]), (2, [2e3, -1.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in vector_topk.top_k(big, big.where("vec_id = 0")).orderBy("rank").collect()] == [2, 1]


def test_topk_lengths_and_large_numbers(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0]), (3, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="1 to 2 components"):
        vector_topk.top_k(v, v.where("vec_id = 0"))
    same = v.where("vec_id <> 2")
    assert {r.vec_id for r in vector_topk.top_k(same, same.where("vec_id = 0")).collect()} == {1, 3}
    for big in (1e17, 1e9):  # a component, a score beyond 64 bits
        w = spark.createDataFrame([(0, [big]), (1, [big])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception):
            vector_topk.top_k(w, w.where("vec_id = 0")).collect()


def test_leaks_small(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 3, 4, 5, 12, 40])))) for i in range(30)] + [(40, None), (41, ""), (None, "w1 w2")]
    docs = []
    for i in range(120):
        t = [r.choice(words) for _ in range(r.choice([0, 4, 60, 300]))]
        k = list((r.choice(items)[1] or "").split())
        if len(k) > 8 and r.random() < 0.6:
            k[r.randrange(len(k))] = "zz"
        at = r.randint(0, len(t))
        docs.append((i, " ".join(t[:at] + k + t[at:]).upper() if i % 3 else " \n ".join(t[:at] + k + t[at:]), 1))
    docs += [(300, None, 1), (None, items[0][1], 1), docs[0]]

    def grams(w, n):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = set()
    for i, t in items:
        w = (t or "").lower().split()
        if i is None or not w:
            continue
        g = grams(w, min(5, len(w)))
        for d, x, _ in docs:
            if d is not None and x:
                shared = len(g & grams(x.lower().split(), min(5, len(w))))
                if 100 * shared >= 75 * len(g):
                    want.add((d, i, len(g), shared))
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, h int")
    out = benchmark_leaks.leaks(d, b)
    assert {tuple(x) for x in out.collect()} == want and out.count() == len(want)
    assert benchmark_leaks.leaks(d.limit(0), b).collect() == [] and benchmark_leaks.leaks(d, b.limit(0)).collect() == []
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_oracles(spark):
    con = oracle.connect(SF)
    for m in (vector_topk, benchmark_leaks):
        oracle.compare(m.query(spark, SF), con, m.ORACLE_SQL)
