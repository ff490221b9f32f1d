from pyspark.sql import functions as F

from helixmill.llm import quality, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None, "x"), (None, "", "x"), (2, "the idiot", "x"), (2, "the idiot", "x"), (3, "word " * 100000, "x"), (4, "\n \t", "x")]


def held_out(spark, out, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(f"{label} is not null")
    rows = out.where("held_out").join(labels, "doc_id").select(label, "score", "predicted").collect()
    pos, neg = [r.score for r in rows if r[0] == 1], [r.score for r in rows if r[0] == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    return auc, sum(r[0] == r.predicted for r in rows) / len(rows)


def check(spark, module, label, threshold):
    out = module.query(spark, SF).cache()
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert out.where("score is null or score < 0 or score > 1").count() == 0
    assert out.where((F.col("predicted") == 1) != (F.col("score") >= threshold)).count() == 0
    auc, accuracy = held_out(spark, out, label)
    assert auc > 0.9 and accuracy > 0.85, (auc, accuracy)
    docs = spark.createDataFrame(ODD, "doc_id long, text string, score string")
    labels = spark.createDataFrame([], f"doc_id long, {label} int")
    model = module.train(docs, labels, F.lit(True))
    assert module.scored(docs, model).where("score between 0 and 1").count() == len(ODD)
    trained = module.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))
    rows = module.scored(docs, trained).collect()
    assert len(rows) == len(ODD) and len({r.score for r in rows if r.doc_id == 2}) == 1
    assert module.scored(docs.limit(0), trained).collect() == []


def test_toxicity(spark):
    check(spark, toxicity, "toxic", 0.7)


def test_quality(spark):
    check(spark, quality, "quality", 0.3)


def test_toxicity_learns_from_all_labels(spark, monkeypatch):
    """No labelled row is left out, whatever their number, and long texts count whole: shards are trained apart and averaged."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 60)
    rows = [(i, ("word " * 14000 if i == 7 else "some plain words ") + (f"bad{i % 3} thing" if i % 2 else f"good{i % 3} thing")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    shards, n, classes = toxicity._shards(docs, labels, F.lit(True), 1 << 15)
    packed = shards.collect()
    assert (n, classes) == (300, 2) and len(packed) == 5
    assert sum(len(r["y"]) // 8 for r in packed) == 300 and sum(len(r["words"]) // 6 for r in packed) == 14000 + 2 * 300 + 3 * 299
    model = toxicity.train(docs, labels, F.lit(True))
    got = {r.doc_id: r.score >= 0.7 for r in toxicity.scored(docs, model).collect()}
    assert sum(got[i] == (i % 2 == 1) for i in got) >= 297
    again = toxicity.train(docs.repartition(7), labels, F.lit(True))
    assert (again.state() == model.state()).all() and again.thresholds == model.thresholds
