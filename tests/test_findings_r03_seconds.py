"""What the findings of round 3 named as slow: lambdas and patterns run letter by letter, and samples gone over again."""

import hashlib

from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_the_log_goes_over_samples_once(spark, monkeypatch):
    from helixmill.plans import catalog

    plans, append = [], catalog.writers.append_summary
    monkeypatch.setattr(catalog.writers, "append_summary", lambda df, path: (plans.append(df.inputFiles()), append(df, path))[1])
    catalog.QUERIES["summary_log"](spark, SMALL)
    assert len(plans) == 2 and not any("documents" in f for files in plans for f in files)


TOKENS = ["AC<EOS>", "<SOS>A<b", "a>b<c>>d", "<a<b>c", "<", ">", "", None, "é中\n<longer than eight>K<longer than eight>", "<x><x>", "\U0001f600<é>"]


def test_tokens_of_a_batch_are_those_of_the_pattern(spark):
    import pyarrow as pa

    from helixmill.functions.arrays import text_bytes, token_codes, token_spans
    from helixmill.functions.sequences import tokenize

    want = [r.t or [] for r in spark.createDataFrame([(t,) for t in TOKENS], "s string").select(tokenize(F.col("s")).alias("t")).collect()]
    for part in (slice(0, 0), slice(0, len(TOKENS)), slice(3, 9)):
        data, offsets = text_bytes(pa.array(TOKENS, pa.string())[part])
        start, end, row = token_spans(data, offsets)
        code, texts = token_codes(data, start, end)
        named = [*map(chr, range(128)), *texts]
        got = [[named[c] for c in code[row == i]] for i in range(len(offsets) - 1)]
        assert got == want[part] and len(set(texts)) == len(texts)


def test_a_vocabulary_goes_over_texts_once_and_encodes_without_lambdas(spark):
    from helixmill.operators import vocabulary

    d = spark.createDataFrame([(t,) for t in TOKENS], "s string")
    vocab = vocabulary.build_vocab(d, "s")
    assert plan(vocab).count("mapinarrow") == 1
    ids = {r.token: r.token_id for r in vocab.collect()}
    assert sorted(ids, key=ids.get) == ["<blank>", *sorted(set(ids) - {"<blank>", "<MASK>"}, key=str.encode), "<MASK>"] and sorted(ids.values()) == [*range(len(ids))]
    out = vocabulary.encode(d, vocab.where("token <> 'C'"), "s", max_length=4, on_error="reject")
    assert "lambda" not in plan(out)
    got = {r.s: r.ids for r in out.collect()}
    assert got["AC<EOS>"] is None and got[None] is None and got["é中\n<longer than eight>K<longer than eight>"] is None
    assert got["<x><x>"] == [ids["<x>"]] * 2 + [0, 0] and got[""] == got["<"] == [0] * 4 and got["a>b<c>>d"] == [ids[t] for t in ("a", "b", "<c>", "d")]


def test_masks_without_lambdas_are_the_draws(spark):
    from helixmill.operators import corruption

    rows = [(1, [5] * 3 + [0] * 65), (2, [7] * 200), (3, []), (4, None), (5, [0, 5, 0, 5]), (6, [5, None, 0]), (None, [5, 5]), (10**15, [0] * 8)]
    d = spark.createDataFrame(rows, "id long, ids array<int>")

    def draw(seed, key, i):
        return int(hashlib.md5(f"{seed}:pos:{key}:{i // 4}".encode()).hexdigest()[i % 4 * 8 : i % 4 * 8 + 8], 16)

    for f, pad in ((lambda: corruption.mask_tokens(d, 48, 0, 3, "id"), 0), (lambda: corruption.mask_loglinear(d, 48, 3, "id"), None)):
        out = f().drop("is_masked")
        assert "element_at" not in plan(out) and "substring(get" not in plan(out)
        for r in out.collect():
            chance = 1 - r.t if pad == 0 else 1 - 2.718281828459045 ** -r.sigma
            want = None if r.ids is None else [48 if x != pad and not (x is None and pad == 0) and r.id is not None and draw(3, r.id, i) < chance * 2**32 else x for i, x in enumerate(r.ids)]
            assert r.masked == want, (r, want)
