import hashlib
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import numpy as np
import pyarrow as pa

from helixmill.llm import common as C
from helixmill.llm import suffix_dedup as S


def brute(rows, k):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        key = float("inf") if d is None else d
        for i in range(len(b) - k + 1):
            w = b[i : i + k]
            first[w] = min(first.get(w, float("inf")), key)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        key = float("inf") if d is None else d
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if first[b[i : i + k]] < key:
                gone[i : i + k] = b"\1" * k
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_for(seed, n=120):
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "dé", "ß", "\0x", "omega"]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    common = text(30)
    rows = [(i, r.choice([text(r.randint(0, 60)), common, text(5) + common + text(9), text(3) + common[:60], "a" * r.randint(0, 200)])) for i in range(n)]
    return rows + [(5, None), (7, ""), (None, common), (3, rows[4][1]), rows[9], (n, "x" * 20000 + common)]


@pytest.mark.parametrize("hot", [2000, 3])
def test_against_brute_force(spark, hot):
    rows = rows_for(1)
    docs = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, chunk string, rid int")
    got = S.remove_repeats(docs, hot=hot).collect()
    got = sorted(((g.doc_id, g.n_bytes, g.n_removed, g.n_spans, hashlib.sha256(bytes(g.kept)).hexdigest()) for g in got), key=str)
    assert got == brute(rows, 50)


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.integers(0, 3), min_size=1, max_size=120), st.integers(1, 20))
def test_common_prefixes(symbols, depth):
    s = np.array(symbols, np.int16)
    sa, parted = S._lcp_groups(s, depth)
    cut = lambda i: symbols[i : i + depth]
    assert sorted(sa.tolist()) == list(range(len(s)))
    padded = [cut(i) + [0] * (depth - len(cut(i))) for i in sa]
    assert all(a <= b for a, b in zip(padded, padded[1:]))
    for i in range(1, len(s)):
        a, b = cut(sa[i - 1]), cut(sa[i])
        if len(a) == depth and len(b) == depth:
            assert parted[i] == (a != b)


@pytest.mark.parametrize("hot", [2000, 2])
def test_passage_in_every_document(spark, hot):
    """A line of all documents reaches a part once a chunk, however often it stands."""
    line = "this line stands in each of the documents, and in some of them more than once. "
    rows = [(i, f"own {i * 7919} " + line * (1 + i % 3) + f"tail {i * 104729}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.remove_repeats(docs, hot=hot).collect()
    got = sorted(((g.doc_id, g.n_bytes, g.n_removed, g.n_spans, hashlib.sha256(bytes(g.kept)).hexdigest()) for g in got), key=str)
    assert got == brute(rows, 50)
    data, offsets = C.text_bytes(pa.array([t for _, t in rows]))
    _, _, key, _, content = S._runs(data, offsets, 50)
    assert len(content) > 4 * len(set(content.tolist()))
    # the buckets that keys are merged in are even
    r = random.Random(1)
    data, offsets = C.text_bytes(pa.array(["".join(r.choice("abcdefgh ") for _ in range(60000))]))
    _, _, key, _, _ = S._runs(data, offsets, 50)
    share = np.bincount((key >> np.uint64(60)).astype(int), minlength=16) / len(key)
    assert len(key) > 2000 and share.max() < 0.12 and share.min() > 0.02
