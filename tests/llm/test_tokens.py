import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from helixmill.llm import common as C
from helixmill.llm import packing, tokens, training_order

TEXTS = [
    "Hello, World! It's   fine...", "a<|endoftext|>b", "<|ENDOFTEXT|>.", "É'S é J̌ J̌", "don't.. 3.5% #x| 　wide", "", None, "x" * 300,
    "foo'. 'tis l'eau… «quoi»", "\0 \x1c a\x85b", "ÅNGSTRÖM, Straße; 𝒳!", "a.b.c, 12,5", "%%% $$$ é%%% _a_ _._", "İstanbul ΣΟΦΟΣ.",
]


def ids(t):
    return Tokenizer.from_file(tokens.tokenizer_path()).encode(t or "", add_special_tokens=False).ids + [1]


def rows():
    r = random.Random(5)
    words = " ".join(t for t in TEXTS if t).split()
    out = list(enumerate(TEXTS)) + [(100 + i, " ".join(r.choice(words) for _ in range(r.choice([3, 40, 700, 2500])))) for i in range(60)]
    return out + [out[0], (None, "no id")]


def test_ids():
    for a, b in zip(TEXTS, tokens.encode_all(TEXTS, tokens.tokenizer_path())):
        assert np.frombuffer(b, np.uint32).tolist() == ids(a), a


def test_packing(spark):
    data = rows()
    docs = spark.createDataFrame([(d, t, 1) for d, t in data], "doc_id long, text string, ids int")
    want = sorted(((d, ids(t)) for d, t in data), key=str)
    for kw in ({}, {"size": 64, "open_windows": 2}):
        size = kw.get("size", 2048)
        pieces = packing.pack(docs, **kw).collect()
        by_seq, total = defaultdict(list), 0
        for p in pieces:
            by_seq[p.sequence_id].append((p.offset, p.length))
            assert len(p.ids) == 4 * p.length
        for s in by_seq.values():
            at = 0
            for o, n in sorted(s):
                assert o == at
                at += n
            assert at <= size
            total += at if at & (at - 1) == 0 else size
        n = sum(len(i) for _, i in want)
        assert total <= 1.15 * n + size
        assert sum(p.length for p in pieces) == n
        # every document's pieces give its ids back (repeated rows: as often as they stand)
        joined = defaultdict(lambda: defaultdict(list))
        for p in pieces:
            joined[(p.doc_id, p.doc_tokens)][p.start].append((p.length, bytes(p.ids)))
        for d, i in want:
            at, got = 0, b""
            while at < len(i):
                n, x = joined[(d, len(i))][at].pop()
                got, at = got + x, at + n
            assert np.frombuffer(got, np.uint32).tolist() == i
    assert packing.pack(docs.limit(0)).collect() == []


def test_feistel():
    for n in (1, 2, 3, 17, 1000, 4097):
        p = training_order.feistel(np.arange(n), n, 7)
        assert sorted(p.tolist()) == list(range(n))
    assert training_order.feistel(np.arange(1000), 1000, 7).tolist() != training_order.feistel(np.arange(1000), 1000, 8).tolist()


def test_shards(spark):
    data = rows()
    docs = spark.createDataFrame([(d, t, 1) for d, t in data], "doc_id long, text string, slot int").repartition(3)
    seqs = C.materialize(training_order.sequences(docs, size=128), "t-seq")
    folder = C.scratch_path(spark, "t-shards")
    shards = C.materialize(training_order.write_shards(training_order.in_training_order(seqs), folder, size=128, per_shard=16), "t-list").collect()
    n = len(shards)
    assert sorted(s.slot for s in shards) == list(range(n))
    got = list(training_order.read_shards(folder, 0, n, size=128, per_shard=16))
    assert len(got) == n
    for s in shards:
        assert zlib.crc32(got[s.slot][: s.n_tokens].tobytes()) == s.ids_crc32
    assert sorted(map(bytes, got)) == sorted(bytes(r.ids) for r in seqs.collect())
    assert [x.tobytes() for x in training_order.read_shards(folder, n // 2, n, size=128, per_shard=16)] == [x.tobytes() for x in got[n // 2 :]]
    # round trip: sequences of a partition, end to end, are its documents' ids
    parts = defaultdict(list)
    for r in seqs.collect():
        parts[r.part].append((r.place, np.frombuffer(r.ids, np.uint16)[: r.n_tokens]))
    docs_back = []
    for p in parts.values():
        stream = np.concatenate([x for _, x in sorted(p, key=lambda y: y[0])])
        docs_back += [tuple(x.tolist()) for x in np.split(stream, np.flatnonzero(stream == 1) + 1) if len(x)]
    assert sorted(docs_back) == sorted(tuple(ids(t)) for _, t in data)
    empty = C.materialize(training_order.sequences(docs.limit(0)), "t-none")
    assert training_order.write_shards(training_order.in_training_order(empty), folder).collect() == []


def test_words_that_are_known_and_a_full_cache(monkeypatch):
    """Ids are the same with what was met before, and when the cache overflows at every slice."""
    r = random.Random(8)
    texts = TEXTS + [" ".join("".join(r.choice("abcé0.") for _ in range(r.choice([1, 3, 9, 20]))) for _ in range(50)) for _ in range(60)]
    want = [ids(t) for t in texts]
    path = tokens.tokenizer_path()
    for cache, size in ((1_500_000, 1 << 22), (20, 300), (0, 1)):
        monkeypatch.setattr(tokens, "CACHE", cache)
        monkeypatch.setattr(tokens, "SLICE", size)
        tokens._STATE.clear()
        for _ in range(2):
            assert [np.frombuffer(b, np.uint32).tolist() for b in tokens.encode_all(texts, path)] == want
    assert tokens.encode_all([], path) == [] and tokens.encode_all([None, ""], path, None) == [b"", b""]
    tokens._STATE.clear()
