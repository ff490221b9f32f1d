from pyspark.sql import functions as F

from helixmill.llm import labelled as L


def test_one_text_an_id(spark):
    docs = spark.createDataFrame([(1, f"copy {i}") for i in range(500)] + [(2, "two"), (3, None), (9, "unlabelled")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    got = L.sample(docs, labels, "toxic", F.lit(True), 10)
    rows = sorted(map(tuple, got.collect()))
    assert got.columns == ["doc_id", "text", "y"] and [r[0] for r in rows] == [1, 2, 3] and [r[1] for r in rows[1:]] == ["two", ""]
    assert sorted(map(tuple, L.sample(docs.repartition(7), labels, "toxic", F.lit(True), 10).collect())) == rows


def test_long_texts_are_not_learned_from(spark):
    docs = spark.createDataFrame([(1, "x" * 101), (2, "y" * 100)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert [r.doc_id for r in L.sample(docs, labels, "toxic", F.lit(True), 10, max_bytes=100).collect()] == [2]
