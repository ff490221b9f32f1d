"""Edge rows worked by hand, readers, batches and plans."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.functions import properties as P
from helixmill.functions import sequences as S
from helixmill.operators import batching, composition, conditions, corruption, evaluation, ranking
from helixmill.plans import catalog
from helixmill.sources import readers, writers

SF = "/root/testdata/sf0.001"


def col(spark, values, f, kind="string"):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, s {kind}")
    return [r[0] for r in d.orderBy("i").select(f(F.col("s"))).collect()]


def test_tokenize(spark):
    got = col(spark, ["<a<b>C", "AB<cd", "A>B", "<<x>>y", ""], S.tokenize)
    assert got == [["<a<b>", "C"], ["A", "B"], ["A", "B"], ["<<x>", "y"], []]


def test_payload_and_validity(spark):
    assert col(spark, ["xx<SOS>AB<EOS>CD<EOS>", "  AB\t", "<SOS>A", "<SOS><EOS>"], S.extract_payload) == ["AB", "AB", "<SOS>A", ""]
    assert col(spark, ["ACk", "ACd", "", "A<B", None], S.is_valid) == [True, False, False, False, False]


def test_scores(spark):
    assert col(spark, ["KKKKRDE", "", None], P.charge_score) == [pytest.approx(0.754840, abs=1e-6), 0.0, 0.0]
    assert col(spark, ["C", "ACDC"], lambda c: P.hmoment(c, 160, True))[0] == 0.0
    moment = col(spark, ["AKL"], lambda c: P.hmoment(c, 100))[0]
    h = [0.62, -1.5, 1.06]
    x = [sum(v * f(math.radians(100) * n) for n, v in enumerate(h, 1)) for f in (math.cos, math.sin)]
    assert moment == pytest.approx(math.hypot(*x) / 3)


def test_deciles(spark):
    d = spark.range(1, 12).select(F.col("id").cast("double").alias("x"))
    assert [r.bin for r in conditions.quantile_bin(d, "x").orderBy("x").collect()] == [0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    with pytest.raises(Exception, match="unique"):
        conditions.quantile_bin(spark.range(3).select(F.lit(1.0).alias("x")), "x").collect()


def test_repeat(spark):
    d = spark.createDataFrame([(1, i, p, True) for i, p in enumerate("AABA")], "config_id int, sample_id int, payload string, is_valid boolean")
    assert [r.is_repeat for r in evaluation.flag_repeat(d, "config_id", "sample_id").orderBy("sample_id").collect()] == [False, True, False, True]


def test_batches(spark):
    pos, neg = (spark.range(n).select("id") for n in (5, 3))
    out = batching.balanced_batches(pos, neg, 4, 0.5, 1).groupBy("batch", "label").count().collect()
    assert sorted((r.batch, r.label, r["count"]) for r in out) == [(0, 0, 2), (0, 1, 2), (1, 0, 2), (1, 1, 2)]
    few = batching.balanced_batches(spark.range(8).select("id"), spark.range(1).select("id"), 4, 0.5, 1)
    assert few.where("label = 0").count() == 4
    with pytest.raises(ValueError):
        batching.balanced_batches(pos, neg, 4, 0.0, 1)
    a = batching.shuffled_batches(spark.range(100).select("id").repartition(7), 8, 3)
    b = batching.shuffled_batches(spark.range(100).select("id").coalesce(1), 8, 3)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_constant_metric_and_no_candidate(spark):
    d = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [r.norm_x for r in ranking.minmax(d, ["x"]).collect()] == [None, None]
    c = spark.createDataFrame([(1, k, "<nblank><SOS>DEDEDEDE<EOS><cblank>", 12) for k in range(3)], "item_id int, k int, candidate string, length int")
    assert [r.k for r in ranking.best_of_k(c).collect()] == [0]


def test_masks_only_tokens(spark):
    d = spark.createDataFrame([(i, [1, 2, 3, 0, 0]) for i in range(50)], "i int, ids array<int>")
    for r in corruption.mask_tokens(d, 9, 0, 1, "i").collect():
        assert r.masked[3:] == [0, 0] and all(m in (x, 9) for m, x in zip(r.masked, r.ids))


def test_readers(spark, tmp_path):
    (tmp_path / "p.csv").write_text(",species,modified_sequence,targetGroups,targetObjects,MIC\n0,escherichia coli,<SOS>A<EOS>,\"['GRAM-', 'GRAM+']\",\"['DNA / RNA']\",2.5\n")
    r = readers.read_peptides(spark, str(tmp_path / "p.csv")).collect()[0]
    assert (r.species, r.targetGroups, r.targetObjects, r.MIC) == ("escherichia coli", ["GRAM-", "GRAM+"], ["DNA / RNA"], 2.5)
    (tmp_path / "v.csv").write_text("A,1\nnocomma\na,b,c\nB,2\nA,7\nC,x\n")
    assert sorted(map(tuple, readers.read_vocab(spark, str(tmp_path / "v.csv")).collect())) == [("A", 7), ("B", 2)]
    for k in (1, 2):
        (tmp_path / f"s{k}.csv").write_text("# a\n# b\nGenerated Sequence,Extracted Sequence,Is Valid,In Training Data,Is Repeat\n" + "x,AC,True,False,False\n" * 3)
    assert readers.read_samples(spark, [str(tmp_path / "s1.csv"), str(tmp_path / "s2.csv")]).count() == 6
    (tmp_path / "log.txt").write_text("\n=== Epoch 0 ===\nAA\nBB\n\n=== Epoch 1 ===\n12   CC\n")
    log = sorted(tuple(r) for r in readers.read_epoch_log(spark, str(tmp_path / "log.txt")).collect())
    assert log == [(0, 0, None, "AA"), (0, 1, None, "BB"), (1, 0, 12, "CC")]
    np.save(tmp_path / "m.npy", np.arange(9.0).reshape(3, 3))
    assert conditions.upper_triangle(readers.read_distance_maps(spark, str(tmp_path / "m.npy"))).count() == 3
    d = spark.createDataFrame([("AC", 1)], "Sequence string, x int")
    assert readers.resolve_column(d, ["nope", "Sequence"]).columns == ["sequence"]
    with pytest.raises(ValueError):
        readers.resolve_column(d, ["nope"])
    vocab = spark.createDataFrame([("A", 1)], "token string, token_id int")
    assert writers.write_vocab(vocab, str(tmp_path / "out")) and not writers.write_vocab(vocab, str(tmp_path / "out"))


def test_plans_are_native(spark):
    for name in ("run_rates", "score_samples", "balanced_batches", "aa_frequency"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "BroadcastNestedLoopJoin LeftOuter" not in plan, name


def test_cleaning_is_computed_once(spark):
    """The whole-text regular expression stands once a view's scan in the optimized plan, whatever uses its result.

    Samples are scanned twice where repeats are told: for the rows and for each payload's first place.
    """
    for name, views in (("run_rates", 3), ("grid_report", 3), ("score_samples", 3), ("run_property_means", 3), ("repeat_flag", 2), ("aa_frequency", 3), ("best_of_k", 1)):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace(text") == views, (name, plan.count("regexp_replace(text"))


def test_more_readers_and_sinks(spark, tmp_path):
    (tmp_path / "n.csv").write_text(",Sequence\n0,ACK\n1,\n")
    assert [tuple(r) for r in readers.read_negatives(spark, str(tmp_path / "n.csv")).collect()] == [("ACK", "<nblank><SOS>ACK<EOS><cblank>"), (None, None)]
    (tmp_path / "p.csv").write_text("sequence\n<SOS>AC<EOS>\nplain\n")
    assert [r.raw_sequence for r in readers.read_proteins(spark, str(tmp_path / "p.csv")).collect()] == ["AC", None]
    (tmp_path / "s.txt").write_text(" <SOS>A<EOS>\n\n  \nB\n")
    assert [r.sequence for r in readers.read_sample_lines(spark, str(tmp_path / "s.txt")).collect()] == ["<SOS>A<EOS>", "B"]
    d = spark.createDataFrame([("AC", 1), ("K", 2)], "first string, x int")
    assert [r.sequence for r in readers.resolve_column(d, ["nope"], "first").collect()] == ["AC", "K"]
    writers.write_scored(d, str(tmp_path / "scored"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "scored")).collect())) == [("AC", 1), ("K", 2)]
    with pytest.raises(Exception, match="exists"):
        writers.write_scored(d, str(tmp_path / "scored"))
    for write, name in ((writers.write_frequencies, "freq"),):
        write(d, str(tmp_path / name))
        assert sorted(map(tuple, spark.read.csv(str(tmp_path / name), header=True).collect())) == [("AC", "1"), ("K", "2")]
        with pytest.raises(Exception, match="exists"):
            write(d, str(tmp_path / name))


def test_runs_of_a_summary(spark, tmp_path):
    head = "# a\nGenerated Sequence,Extracted Sequence,Is Valid,In Training Data,Is Repeat\n"
    (tmp_path / "a b.csv").write_text(head + "x,KKKKRDE,True,False,False\nx,KKKKRDE,True,True,False\nx,,False,False,False\n")
    (tmp_path / "none.csv").write_text(head + "x,AC,True,True,False\n")
    files = [str(tmp_path / n) for n in ("a b.csv", "none.csv", "missing.csv")]
    summary = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "config_id int, output_file string")
    out = {r.config_id: r.mean_charge_score for r in evaluation.attach_runs(summary, readers.read_runs(spark, summary)).collect()}
    assert out == {0: pytest.approx(0.754840, abs=1e-6), 1: None, 2: None}
    nowhere = summary.where("config_id = 2")
    assert [r.mean_gravy_score for r in evaluation.attach_runs(nowhere, readers.read_runs(spark, nowhere)).collect()] == [None]


def test_lists_flags_and_empty_sides(spark):
    d = spark.createDataFrame([("<SOS>AC<EOS>", "True"), ("AC", "no"), ("A1", "1"), (None, "1")], "s string, `Is Valid` string")
    assert [r.payload for r in batching.training_list(d, "s").collect()] == ["AC", "AC"]
    assert batching.load_for_frequency(d, "s").count() == 1 and batching.load_for_frequency(d, "s", only_valid=False).count() == 2
    assert batching.load_for_frequency(d.select("s"), "s").count() == 2
    q = spark.createDataFrame([("a", "KR"), ("b", "")], "source string, residues string")
    assert composition.charge_summary(q, ["a"]).count() == 1
    with pytest.raises(Exception, match="no residues in b"):
        composition.charge_summary(q, ["a", "b"]).collect()


def test_negative_conditions_by_hash(spark):
    d = spark.range(400).select("id")
    rows = [r.condition for r in conditions.negative_condition(d, "hash", 1, "id").collect()]
    assert all(len(c) == 26 and sum(c[:6]) == 1 and sum(c[6:16]) == 0 and sum(c[16:]) == 1 for c in rows)
    assert len({c[:6].index(1.0) for c in rows}) == 6 and len({c[16:].index(1.0) for c in rows}) == 10
    again = conditions.negative_condition(d.repartition(3), "hash", 1, "id").orderBy("id").collect()
    assert [r.condition for r in again] == rows


def test_draws_are_shared_and_even(spark):
    """Four positions take one digest; each has its own 32 bits, and its chance holds."""
    import hashlib

    from helixmill.hashrand import bar_of, draw_below, draws

    d = spark.range(300).select("id", draws(F.concat(F.lit("s:"), F.col("id").cast("string"), F.lit(":")), F.lit(10)).alias("d"))
    for chance in (0.0, 0.3, 1.0):
        got = {r.id: r.h for r in d.select("id", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: draw_below(F.col("d"), i, bar_of(F.lit(chance)))).alias("h")).collect()}  # noqa: B023
        for i, hits in got.items():
            assert hits == [int(hashlib.md5(f"s:{i}:{k // 4}".encode()).hexdigest()[k % 4 * 8 :][:8], 16) / 2**32 < chance for k in range(10)]
    assert d.select(F.max(F.size("d"))).first()[0] == 3
    assert spark.range(1).select(F.size(draws(F.lit("x"), F.lit(0))).alias("n")).first().n == 0


def test_vocabulary_that_is_too_large_is_an_error(spark, monkeypatch):
    from helixmill.operators import vocabulary

    d = spark.createDataFrame([("A<EOS>é",), ("",), ("A" * 70,)], "s string")
    vocab = vocabulary.build_vocab(d.limit(1), "s")
    ids = [r.ids for r in vocabulary.encode(d, vocab, "s", on_error="reject").collect()]
    token = {r.token: r.token_id for r in vocab.collect()}
    assert ids[0][:4] == [token["A"], token["<EOS>"], token["é"], 0] and ids[1] == [0] * 68 and ids[2] is None
    monkeypatch.setattr(vocabulary, "LARGEST", 2)
    with pytest.raises(Exception, match="can't be broadcast"):
        vocabulary.encode(d, vocab, "s", on_error="reject").collect()


def test_losses_take_one_shuffle(spark):
    s = spark.createDataFrame([(1, 0, t, 800.0 * t) for t in range(4)] + [(1, 1, 2, 1.0), (2, 0, 1, -3.0), (2, 0, 2, None)], "item_id int, pos int, token_id int, score double")
    t = spark.createDataFrame([(1, 0, 2, True), (1, 1, 3, True), (2, 0, 1, True), (3, 0, 1, True)], "item_id int, pos int, target int, is_masked boolean")
    losses = {(r.item_id, r.pos): r.loss for r in corruption._losses(s, t, []).collect()}
    assert losses == {(1, 0): pytest.approx(800.0), (1, 1): None, (2, 0): pytest.approx(0.0)}
    plan = corruption._losses(s, t, [0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    plan = catalog.QUERIES["draw_category"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_grid_of_bounded_scales(spark):
    g = batching.param_grid(a=spark.range(3).select("id"), b=spark.createDataFrame([(1,), (1,), (2,)], "x int"))
    assert sorted(map(tuple, g.collect())) == [(a, b) for a in range(3) for b in (1, 2)]
    with pytest.raises(ValueError, match="more than 2 values"):
        batching.param_grid(2, a=spark.range(3).select("id"))
