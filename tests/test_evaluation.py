"""Evaluation by distinct payload against row by row."""

import pytest
from pyspark.sql import functions as F

from helixmill.operators import evaluation


@pytest.fixture(scope="module")
def samples(spark):
    texts = ["<SOS>KKKKRDE<EOS>", "KKKKRDE", "<SOS>ACDC<EOS>", "bad seq", "", None, "<SOS>CCKLW<EOS>"]
    rows = [(i, (i * i) % 3 if i % 5 else None, texts[(i * 7) % len(texts)]) for i in range(200)]
    return spark.createDataFrame(rows, "sample_id int, config_id int, generated_sequence string").cache()


@pytest.fixture(scope="module")
def training(spark):
    return spark.createDataFrame([("ACDC",), ("K",)], "payload string")


def test_rates_and_means_of_payloads_are_those_of_rows(samples, training):
    rows = evaluation.score_samples(evaluation.judged(samples, training)).toPandas()
    report = evaluation.run_report(evaluation.score_samples(evaluation.by_payload(samples, training)))
    rates = {r.config_id: r.asDict() for r in evaluation.run_rates(evaluation.by_payload(samples, training)).collect()}
    for r in report.collect():
        mine = rows[rows.config_id.isna()] if r.config_id is None else rows[rows.config_id == r.config_id]
        assert r.total_samples == len(mine) and r.valid_count == mine.is_valid.sum()
        assert r.novel_count == (mine.is_valid & ~mine.known).sum() and r.repeat_count == mine.is_repeat.sum()
        scored = mine[mine.scored]
        for n in ("charge_score", "alpha_score", "beta_score", "boman_index", "gravy_score"):
            assert r[f"mean_{n}"] == pytest.approx(scored[n].mean())
        assert all(r[k] == v for k, v in rates[r.config_id].items())


def test_samples_are_scanned_once(samples, training):
    plan = evaluation.run_rates(evaluation.by_payload(samples, training))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") + plan.count("generated_sequence#") > 0
    assert plan.count("InMemoryRelation") == 1


def test_summary_of_runs_that_one_side_lacks(spark, samples, training):
    rates = evaluation.run_rates(evaluation.by_payload(samples, training))
    settings = spark.createDataFrame([(0, 1.0, 2.0, 3.0, "a.csv"), (9, 4.0, 5.0, 6.0, "b.csv")], "config_id int, species_scale double, groups_scale double, mic_scale double, output_file string")
    rows = {r.config_id: r for r in evaluation.summary_row(rates, settings).collect()}
    assert set(rows) == {None, 0, 1, 9}
    assert rows[9].total_samples == 0 and rows[9].success_rate == "0.00" and rows[9].output_file == "b.csv"
    assert rows[1].total_samples > 0 and rows[1].output_file is None and rows[1].species_scale is None
    assert rows[0].total_samples > 0 and rows[0].output_file == "a.csv"
    with pytest.raises(Exception, match="settings or samples missing"):
        evaluation.summary_row(rates, settings, on_missing="raise").collect()
    whole = evaluation.summary_row(rates.where("config_id = 0"), settings.where("config_id = 0"), on_missing="raise")
    assert whole.select(F.count("*")).first()[0] == 1


def test_runs_without_samples_and_samples_without_a_run(spark, samples, training):
    runs = spark.createDataFrame([(0,), (7,)], "config_id int")
    for scored in (evaluation.score_samples(evaluation.flagged(samples, training)), evaluation.score_samples(evaluation.by_payload(samples, training))):
        means = {r.config_id: r.mean_charge_score for r in evaluation.run_property_means(scored, runs).collect()}
        assert set(means) == {None, 0, 1, 7} and means[7] is None and means[0] is not None
