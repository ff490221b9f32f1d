"""What the findings of round 3 named: work that is done more than once, or by a task that sees too much."""

import re

from pyspark.sql import functions as F

from helixmill.functions.sequences import extract_payload
from helixmill.hashrand import digest, hash_rank
from helixmill.operators import batching, evaluation, membership
from helixmill.operators.vocabulary import decode_argmax
from helixmill.plans import catalog

SMALL = "/root/testdata/sf0.001"
TEXTS = ["a<SOS>kl<EOS>b", "<SOS>a\nb<EOS>", "<SOS>a\n<SOS>b<EOS>c<EOS>", "<EOS><SOS>x", " <SOS>x\t", "<SOS><SOS>y<EOS>", "<SOS><EOS>", "", " \n k ", "<SOS>é中<EOS>", None]


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_known_rows_compute_a_payload_once(spark):
    s = spark.createDataFrame([(x,) for x in TEXTS], "generated_sequence string")
    training = batching.training_set(s.select("generated_sequence"), None)
    out = evaluation.known(s.withColumn("payload", extract_payload(F.col("generated_sequence"))), training)
    assert "RLIKE(CASE" not in plan(out)
    assert sorted(r.payload for r in out.collect()) == ["k", "kl"]


def test_payloads_with_and_without_line_breaks(spark):
    def by_hand(x):
        hit = x if x is None else re.search(r"<SOS>([^\n]*?)<EOS>", x)
        return x if x is None else hit.group(1) if hit else x.strip()

    rows = spark.createDataFrame([(x,) for x in TEXTS], "x string").select("x", extract_payload(F.col("x")).alias("p")).collect()
    assert [r.p for r in rows] == [by_hand(r.x) for r in rows]


def test_a_sketch_reads_samples_twice(spark):
    """Once for those that it lets pass and once for all others; invalid ones had a third pass."""
    words = F.element_at(F.array(F.lit("kl"), F.lit("b1"), F.lit("kk"), F.lit("y")), (F.col("id") % 4 + 1).cast("int"))
    s = spark.range(0, 44).select("id", words.alias("payload")).withColumn("is_valid", F.col("payload") != "b1")
    training = spark.createDataFrame([("kl",), ("b1",)], "payload string")
    out = evaluation.flag_known(s, training, membership.build(training, "payload", 2))
    assert plan(out).count("Range (0, 44") == 2
    assert {(r.payload, r.known) for r in out.collect()} == {("kl", True), ("b1", False), ("kk", False), ("y", False)} and out.count() == 44


def test_blend_aggregates_after_its_shuffle(spark):
    out = plan(catalog.QUERIES["blend_scores"](spark, SMALL), "executedPlan")
    assert not re.search(r"hashpartitioning\(item_id#\d+L?, pos#\d+L?, token_id", out) and re.search(r"hashpartitioning\(item_id#\d+L?, pos#\d+L?, \d+\)", out)


def test_argmax_has_one_shuffle(spark):
    s = spark.createDataFrame([(1, 0, 0, 0.5), (1, 0, 1, 0.5), (1, 1, 2, 3.0), (1, 1, 0, 1.0), (2, 0, 1, 1.0)], "item_id long, pos int, token_id int, score double")
    out = decode_argmax(s, spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "token_id int, token string"))
    assert plan(out, "executedPlan").count("hashpartitioning") == 1
    assert {tuple(r) for r in out.collect()} == {(1, "ac"), (2, "b")}


def test_ranks_write_sixteen_bytes_a_hash(spark):
    d = spark.range(300)
    out = hash_rank(d, "3", "id", range_rows=10)
    assert "_h:binary" in plan(out, "executedPlan")
    want = [r.id for r in d.orderBy(digest("3", "id"), "id").collect()]
    assert [r.id for r in out.orderBy("rank").collect()] == want
