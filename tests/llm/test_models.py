"""The classifiers against plain restatements: exact neighbours, and a numeric gradient."""

import numpy as np

from helixmill.llm import quality as Q
from helixmill.llm import toxicity as T


def test_votes_equal_brute_force():
    r = np.random.default_rng(5)
    texts = [" ".join(r.choice(["alpha", "be,ta", "G4", "d-e", "é", "ZZ"], r.integers(1, 30))) for _ in range(140)] + [""]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    idf = np.linspace(1, 2, Q.DIM).astype(np.float32)
    space = r.normal(size=(Q.DIM, 12)).astype(np.float32)
    y = r.integers(0, 2, 60)
    m = Q.Model(idf, space, None, y, 7)
    near = Q._vectors(data, offsets, idf)[:60]
    m.near = m.project(near)
    got = m.score(data, offsets, block=16)
    for i in range(len(texts) - 1):
        x = Q._vectors(data, offsets, idf)[i].astype(float) @ space.astype(float)
        sims = [float(x @ (v @ space) / np.linalg.norm(x) / np.linalg.norm(v @ space)) for v in near.astype(float)]
        best = sorted(range(60), key=lambda k: -sims[k])[:7]
        w = [max(sims[k], 0) ** 8 for k in best]
        want = sum(a * y[k] for a, k in zip(w, best)) / sum(w)
        if sorted(sims)[-7] - sorted(sims)[-8] > 1e-5:  # no tie at the edge
            assert abs(got[i] - want) < 1e-3
    assert got[-1] == y.mean()


def test_gradient_equals_differences():
    r = np.random.default_rng(2)
    m = T.Model(buckets=40, dim=3, filters=4)
    m.p = {k: r.normal(0, 0.5, v.shape) for k, v in m.p.items()}
    b = r.integers(0, 40, (30, 3))
    rows = np.sort(r.integers(0, 5, 30))
    rows[:2], rows[-1] = 0, 4
    y = np.array([1, 0, 1, 1, 0])

    def loss():
        pooled, _ = m._pool(rows, m._embed(b), 5)
        z = pooled @ m.p["v"] + m.p["b"]
        return float(np.mean(np.log1p(np.exp(-z)) + (1 - y) * z))

    # pooled responses are kept as 32-bit numbers, so differences are only so exact
    g = m.gradients(rows, b, y)
    for name, value in m.p.items():
        for at in r.choice(value.size, min(12, value.size), replace=False):
            old, step = value.flat[at], 1e-3
            value.flat[at] = old + step
            up = loss()
            value.flat[at] = old - step
            down = loss()
            value.flat[at] = old
            assert abs((up - down) / (2 * step) - g[name].flat[at]) < 2e-3, name
