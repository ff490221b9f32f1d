from helixmill.llm import jaccard_join as J


def test_texts_without_words_link_with_nothing(spark):
    rows = [(i, [None, "", " ", "\n\t \n"][i % 4]) for i in range(120)] + [(500, "a b"), (501, "A  b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    width = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (width, "1"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similar_groups(docs).collect()}
            assert got == {d: (0, d) for d in range(120)} | {500: (1, 500), 501: (1, 500)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
