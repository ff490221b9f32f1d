import random
import re

from helixmill.llm import jaccard_join as J


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    ids = [d for d, _ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ids[i] is not None and ids[j] is not None:
                inter = len(sets[i] & sets[j])
                if ids[i] == ids[j] or (inter and 100 * inter >= 75 * len(sets[i] | sets[j])):
                    parent[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(s), None if d is None else low[find(i)]) for i, (d, s) in enumerate(zip(ids, sets))), key=str)


def rows_for(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["É", "x\0y"]
    text = lambda k: [r.choice(words) for _ in range(k)]
    bases = [text(r.randint(3, 90)) for _ in range(12)]
    rows = []
    for i in range(220):
        t = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            t[r.randrange(len(t))] = r.choice(words)
        if r.random() < 0.2:
            t = text(r.randint(0, 40))
        s = " ".join(t)
        rows.append((i, s.upper() if r.random() < 0.3 else s.replace(" ", "\n\t", 1)))
    return rows + [(3, None), (7, "É"), (None, rows[0][1]), (300, rows[0][1]), (300, "lonely words in here now"), (301, ""), (302, "a b"), (303, "A  b"), (304, " ".join(text(5000))), rows[5]]


def test_against_brute_force(spark):
    rows = rows_for(3)
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, chunk int, node string")
    got = sorted(((g.doc_id, g.n_shingles, g.component_id) for g in J.similar_groups(docs).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert J.similar_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_words_that_a_polynomial_hash_takes_for_one(spark):
    """A Thue-Morse word of 1024 signs and its complement share nothing, alone or within longer texts."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rest = "some more words that both of them have in the same order"
    rows = [(1, word), (2, other), (3, word), (4, f"{word} x y z {word}"), (5, f"{other} x y z {other}"), (6, f"{rest} {word}"), (7, f"{rest} {other}"), (8, "a\0 b c d e"), (9, "a b c d e")]
    got = {r.doc_id: r.component_id for r in J.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9}
