import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import oracle
from helixmill.llm import source_divergence as D

SF = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "text string, lang string, source string, term string, n long, id int"


def brute(rows, min_docs, top):
    groups, whole, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]
        groups[lang, source].update(found)
        whole[lang].update(found)
        docs[lang].update(set(found))
        sources[lang].add(source)
    out = []
    for lang in sources:
        kept = sorted((t for t in docs[lang] if docs[lang][t] >= min_docs), key=str.encode)
        v = len(kept)

        def p(counts, t):
            return 1 + 10**9 * (counts[t] + 5) // (sum(counts[k] for k in kept) + 5 * v)

        for s in sources[lang]:
            mine = groups[lang, s]
            pairs = [(sum(abs(p(mine, t) - p(groups[lang, o], t)) for t in kept), o) for o in sources[lang] - {s}]
            terms = [(p(mine, t) - p(whole[lang], t), t) for t in kept if mine[t] and p(mine, t) > p(whole[lang], t)]
            for part, rank_to, found in (("pair", len(pairs), pairs), ("term", top, terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:rank_to])]
    return sorted(out)


def made():
    r = random.Random(5)
    words = ["a", "B", "b", "ñandú", "ÑANDÚ", "日本語の長い文字列", "x" * 17, "x" * 18, "sixteen_letters", "abcdefghijklmnop", "eight888", "It's", "tab\tnew\nline", "1234", "--"] + [f"{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    rows = []
    for i in range(240):
        source = r.choice(["hot", "hot", "hot", "s1", "s2", "é", None, ""])
        text = r.choice([" ", ",", "\x00"]).join(r.choice(words) for _ in range(r.choice([0, 1, 5, 40])))
        rows.append((r.choice([None, text, text, text]), r.choice(["en", "en", "en", "de", None, ""]), source, "x", 1, i))
    rows += [("zz only", "one", "s", "x", 1, 0), ("!!", "none", "a", "x", 1, 0), (None, "none", "b", "x", 1, 0), rows[7], rows[7]]
    return rows


@pytest.mark.parametrize("min_docs, top, block, slice_", [(3, 5, 8, 64), (1, 1000, 1 << 16, 1 << 23), (10**6, 5, 8, 1 << 10)])
def test_all_groups_against_brute_force(spark, min_docs, top, block, slice_):
    rows = made()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(map(tuple, D.divergence(docs, min_docs, top, block).collect()))
    assert got == brute(rows, min_docs, top)


def test_no_rows_and_one_source(spark):
    assert D.divergence(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([("a b", "en", "s", "x", 1, 1)], SCHEMA)
    assert D.divergence(one, 1).collect() == []  # no other source, and no term above its own language


def test_galloping():
    r = np.random.default_rng(1)
    for n, m in ((0, 5), (5, 0), (1, 1000), (1000, 1), (700, 900), (3, 10**5)):
        a, b = (np.sort(r.choice(10**6, k, replace=False)) for k in (n, m))
        for stride in (1, 4, 256):
            assert (D.gallop(a, b, stride) == np.searchsorted(b, a)).all()


def test_shares_are_exact():
    r = random.Random(2)
    for _ in range(300):
        v = r.choice([1, 7, 10**6])
        n = r.choice([0, 1, 10**6, 10**12, 8 * 10**15])
        c = r.randint(0, n)
        assert int(D.shares(c, n, v)) == 1 + 10**9 * (c + 5) // (n + 5 * v)
    with pytest.raises(ValueError):
        D.shares(1, 10**16, 1)


def test_terms_of_equal_ends():
    """Terms beyond 16 bytes, and two that a polynomial hash takes for one, keep apart."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    text = f"{word} {other} {'x' * 16}y {'x' * 16}z".encode()
    group, terms, number, n, docs = D.count_terms(np.frombuffer(text, np.uint8), np.array([0, len(text)]), np.zeros(1, np.int64))
    assert sorted(terms) == sorted([word, other, "x" * 16 + "y", "x" * 16 + "z"]) and n.tolist() == docs.tolist() == [1] * 4


def test_sql(spark):
    oracle.compare(D.query(spark, SF), oracle.connect(SF), D.ORACLE_SQL)
