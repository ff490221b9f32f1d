"""Best fit and what is emitted, against a plain simulation; and the padding over a whole table."""

import random

from helixmill.llm import packing, tokens

SF = "/root/testdata/sf0.01"


def simulate(lengths, size, open_windows):
    """Windows of (document, start, length) in the order in which they are emitted, then those left open."""
    done, windows = [], []
    for doc, total in lengths:
        start = 0
        while total - start >= size:
            done.append([(doc, start, size)])
            start += size
        rest = total - start
        if not rest:
            continue
        fits = [w for w in windows if sum(p[2] for p in w) + rest <= size]
        if fits:
            w = max(fits, key=lambda w: sum(p[2] for p in w))
        else:
            if len(windows) == open_windows:
                full = max(windows, key=lambda w: sum(p[2] for p in w))
                windows.remove(full)
                done.append(full)
            w = []
            windows.append(w)
        w.append((doc, start, rest))
        if sum(p[2] for p in w) == size:
            windows.remove(w)
            done.append(w)
    return done, windows


def test_policy(spark):
    r = random.Random(9)
    docs = [(i, " ".join("word" for _ in range(r.choice([0, 1, 5, 9, 14, 15, 16, 31, 40])))) for i in range(300)]
    path = tokens.tokenizer_path()
    lengths = [(i, len(t) // 4) for (i, _), t in zip(docs, tokens.encode_all([t for _, t in docs], path))]
    size, windows = 16, 5
    done, left = simulate(lengths, size, windows)
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).sortWithinPartitions("doc_id")
    by = {}
    for p in packing.pack(table, size, windows).collect():
        by.setdefault(p.sequence_id, []).append((p.offset, p.doc_id, p.start, p.length))
    made = [[x[1:] for x in sorted(by[s])] for s in sorted(by) if s < 1 << 62]
    assert made == [list(map(tuple, w)) for w in done]
    rest = [x for s in sorted(by) if s >= 1 << 62 for x in sorted(by[s])]
    assert sum(x[3] for x in rest) == sum(p[2] for w in left for p in w)


def test_padding_over_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    used = {}
    for p in packing.pack(docs).select("sequence_id", "length").collect():
        used[p.sequence_id] = used.get(p.sequence_id, 0) + p.length
    total = sum(n if n & (n - 1) == 0 else 2048 for n in used.values())
    assert total <= 1.02 * sum(used.values())
