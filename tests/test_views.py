import re

import pytest

from helixmill.adapters import view

SF = "/root/testdata/sf0.001"


def test_scores_hold_all_events(spark):
    s = view(spark, SF, "scores")
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id")
    assert s.select("item_id").distinct().count() == events.distinct().count()
    assert s.count() == 100 * events.count() == s.select("item_id", "pass", "pos", "token_id").distinct().count()


@pytest.mark.parametrize("name, piece", [("samples", "pep"), ("amp", "regexp_extract(modified_sequence, '<SOS>(.*?)<EOS>', 1)"), ("candidates", "regexp_extract(candidate, '<SOS>(.*?)<EOS>', 1)")])
def test_pieces_are_the_whole_texts(spark, name, piece):
    keys = ("item_id", "k") if name == "candidates" else ("sample_id" if name == "samples" else "peptide_id",)
    got = {}
    for *key, pep in view(spark, SF, name).selectExpr(*keys, f"{piece} as p").orderBy(*keys).collect():
        got[key[0] >> 24] = got.get(key[0] >> 24, "") + pep
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == {d: letters for d, t in docs if (letters := re.sub("[^ACDEFGHIKLMNPQRSTVWYacfhiklnpqrstvwy]", "", t))}


def test_texts_without_letters(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "123 !"), (4, "ACK" * 20)], "doc_id long, text string")
    rows = view(spark, SF, "samples", documents=docs).select("sample_id", "pep").collect()
    assert {r.sample_id >> 24 for r in rows} == {4} and "".join(r.pep for r in sorted(rows)) == "ACK" * 20
    assert len({r.sample_id for r in rows}) == len(rows)
