import hashlib
import math
import random

import numpy as np
import pytest

import oracle
from helixmill.llm import ball_codes as B

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, part int, sums string"


def test_balls_find_what_a_full_search_finds():
    """Over few different values, so that most distances have ties."""
    r = np.random.default_rng(7)
    for n, k, w, most in ((400, 64, 4, 3), (300, 7, 1, 50), (200, 40, 3, 2), (50, 1, 2, 9), (0, 5, 2, 9), (500, 64, 8, 1000)):
        x, old, new = r.integers(-most, most + 1, (n, w)), r.integers(-most, most + 1, (k, w)), r.integers(-most, most + 1, (k, w))
        for own in (B.full_search(x, old)[0], r.integers(0, k, n)):
            near, distance, _ = B.ball_search(x, new, own)
            want, d, _ = B.full_search(x, new)
            assert (near == want).all() and (distance == d).all()


def test_balls_save_distances():
    r = np.random.default_rng(8)
    centres = r.integers(-10_000, 10_000, (64, 8))
    x = np.repeat(centres, 50, 0) + r.integers(-40, 41, (3200, 8))
    own, _, full = B.full_search(x, centres)
    near, _, work = B.ball_search(x, centres + r.integers(-3, 4, centres.shape), own)
    assert (near == own).all() and work == len(x) and full == 64 * len(x)  # all in stable cores: a distance each
    wide = np.repeat(centres, 50, 0) + r.integers(-4000, 4001, (3200, 8))
    own, _, full = B.full_search(wide, centres)
    moved = centres + r.integers(-300, 301, centres.shape)
    near, _, work = B.ball_search(wide, moved, own)
    assert (near == B.full_search(wide, moved)[0]).all() and work < full / 2


def test_large_distances_are_exact_or_errors():
    x, e = np.array([[2**28, 1], [2**28, 0]]), np.array([[2**28 - 1, 0], [2**28, 3]])
    assert B.squared(x, e).tolist() == [[2, 4], [1, 9]]
    with pytest.raises(ValueError):
        B.squared(np.full((1, 4), 2**31), np.zeros((1, 4), np.int64))


def brute(rows, parts, entries, rounds, scale):
    kept = [(i, [math.floor(scale * y) for y in v], label) for i, v, label, *_ in rows if v is not None and all(y is not None and math.isfinite(y) for y in v)]
    kept.sort(key=lambda t: (t[0] is None, t[0] or 0, t[1]))
    w = len(kept[0][1]) // parts
    books = [[v[p * w : (p + 1) * w] for _, v, _ in kept[:entries]] for p in range(parts)]

    def assign():
        out = []
        for _, v, _ in kept:
            out.append([min((sum((a - b) ** 2 for a, b in zip(v[p * w : (p + 1) * w], e)), k) for k, e in enumerate(books[p])) for p in range(parts)])
        return out

    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [v[p * w : (p + 1) * w] for (_, v, _), a in zip(kept, near) if a[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    near = assign()
    return [(i, "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a), label) for (i, _, label), a in zip(kept, near)], books


@pytest.mark.parametrize("parts, entries, scale", [(4, 5, 256), (2, 64, 3), (1, 2, 256)])
def test_all_vectors_against_brute_force(spark, parts, entries, scale):
    r = random.Random(parts)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)], r.choice([None, 1, 2]), 1, "x") for i in range(150)]
    rows += [(500, None, 1, 1, "x"), (501, [None] + [1.0] * 7, 1, 1, "x"), (502, [float("nan")] * 8, 1, 1, "x"), (-3, [float("inf")] * 8, 1, 1, "x"), (None, [0.25] * 8, 1, 1, "x"), (None, [-0.25] * 8, None, 1, "x"), rows[4], rows[4], (9, rows[5][1], 2, 1, "x")]
    v = spark.createDataFrame(rows, SCHEMA).repartition(3)
    codes, books = B.compress(v, parts, entries, 2, scale)
    want, want_books = brute(rows, parts, entries, 2, scale)
    assert books.tolist() == want_books
    assert sorted(((a.vec_id, a.code, a.error, a.label and int(a.label)) for a in codes.collect()), key=str) == sorted(want, key=str)
    sums = {}
    for _, _, e, label in want:
        sums[label] = sums.get(label, 0) + e
    for small in (1 << 16, 0):
        got = B.label_errors(codes, small).collect()
        assert len(got) == len(want) and all(g.label_error == sums[g.label and int(g.label)] for g in got)


def test_no_vectors_few_vectors_and_errors(spark):
    assert B.compress(spark.createDataFrame([], SCHEMA))[0].collect() == []
    assert B.label_errors(B.compress(spark.createDataFrame([(1, None, 1, 1, "")], SCHEMA))[0]).collect() == []
    few, books = B.compress(spark.createDataFrame([(2, [1.0] * 16, 1, 1, ""), (1, [2.0] * 16, 1, 1, "")], SCHEMA))
    assert books.shape == (16, 2, 1) and {r.vec_id: r.code for r in few.collect()} == {1: "00" * 16, 2: "01" * 16}
    for bad in ([(1, [1.0] * 16), (2, [1.0] * 32)], [(1, [1.0] * 15)], [(1, [1e9] * 16)]):
        with pytest.raises(Exception):
            B.compress(spark.createDataFrame([(*b, 1, 1, "") for b in bad], SCHEMA))[0].collect()


def test_sql(spark):
    out = B.query(spark, SF)
    oracle.compare(out, oracle.connect(SF), B.ORACLE_SQL)
    _, books = B.compress(spark.read.parquet(f"{SF}/embeddings.parquet"))
    assert out.first().codebooks_sha256 == hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
