"""Validity, novelty and repetition of generated samples, and their scores by run."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.functions import properties as P
from helixmill.functions.barrier import held
from helixmill.functions.sequences import extract_payload, is_valid, parse_flag
from helixmill.operators import membership


def judged(samples: DataFrame, training: DataFrame, run: str = "config_id", order: str = "sample_id") -> DataFrame:
    """Adds ``payload``, ``is_valid``, ``known`` and ``is_repeat`` to every row."""
    return flag_repeat(flagged(samples, training), run, order)


def flagged(samples: DataFrame, training: DataFrame, sketch: DataFrame | None = None) -> DataFrame:
    """Adds ``payload``, ``is_valid`` and ``known``: what a row tells without the others of its run."""
    s = held(samples.withColumn("payload", extract_payload(F.col("generated_sequence"))))
    return flag_known(held(s.withColumn("is_valid", is_valid(F.col("payload")))), training, sketch)


def by_payload(samples: DataFrame, training: DataFrame, run: str = "config_id", sketch: DataFrame | None = None) -> DataFrame:
    """(run, payload, n, is_valid, known): a row for each distinct payload of a run and how often it stands there.

    What depends on the payload alone (validity, novelty, scores) is found once for all its copies, and a
    run's repeats are what ``n`` has beyond one. Samples are read once.
    """
    s = held(samples.select(run, extract_payload(F.col("generated_sequence")).alias("payload")))
    counts = s.groupBy(run, "payload").agg(F.count("*").alias("n"))
    return flag_known(held(counts.withColumn("is_valid", is_valid(F.col("payload")))), training, sketch)


def flag_known(samples: DataFrame, training: DataFrame, sketch: DataFrame | None = None) -> DataFrame:
    """``known``: a valid payload of the training set (distinct payloads).

    ``sketch``: a membership sketch of that set (``operators.membership``). Payloads that it rules out
    aren't sent to the join; those that it lets pass in error are found novel by the join, as without it.
    """
    t = training.select("payload", F.lit(True).alias("_known"))
    if sketch is not None:
        asked = samples.withColumn("_key", F.when(F.col("is_valid"), F.col("payload")))
        hit = held(membership.probe(asked, "_key", sketch, "_maybe").drop("_key"))
        out = hit.where("not _maybe").drop("_maybe").withColumn("known", F.lit(False))
        found = hit.where("_maybe").drop("_maybe").join(t, "payload", "left").withColumn("known", F.coalesce("_known", F.lit(False)))
        return out.unionByName(found.select(*out.columns))
    return samples.join(t, "payload", "left").withColumn("known", F.col("is_valid") & F.coalesce("_known", F.lit(False))).drop("_known")


def novel(samples: DataFrame, training: DataFrame) -> DataFrame:
    return samples.join(training, "payload", "left_anti")


def known(samples: DataFrame, training: DataFrame) -> DataFrame:
    # held, since Spark infers the training set's filter for the samples and would compute the payload again for each part of it
    return held(samples).join(training, "payload", "left_semi")


def flag_repeat(samples: DataFrame, run: str, order: str) -> DataFrame:
    """``is_repeat``: a valid payload that stood earlier in the run. First places are an aggregate, so no payload is a hot window."""
    first = samples.where("is_valid").groupBy(F.col(run).alias("_run"), F.col("payload").alias("_payload")).agg(F.min(order).alias("_first"))
    same = F.col(run).eqNullSafe(F.col("_run")) & (F.col("payload") == F.col("_payload"))
    repeat = F.col("is_valid") & F.coalesce(F.col(order) > F.col("_first"), F.lit(False))
    return samples.join(first, same, "left").withColumn("is_repeat", repeat).drop("_run", "_payload", "_first")


def ratio(a: Column, b: Column) -> Column:
    """Percent, 0 where the denominator is."""
    return F.when(b == 0, 0.0).otherwise(F.round(100.0 * a / b, 2))


def _counts() -> list[Column]:
    """Totals of a run from the rows of ``by_payload``."""
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    valid = F.col("is_valid")
    return [F.sum("n").alias("total_samples"), total(valid).alias("valid_count"), total(valid & ~F.col("known")).alias("novel_count"), F.count_if(valid).alias("unique_count")]


def _rates(counts: DataFrame) -> DataFrame:
    c = F.col
    return counts.withColumn("repeat_count", c("valid_count") - c("unique_count")).withColumns(
        {
            "success_rate": ratio(c("valid_count"), c("total_samples")),
            "novelty_rate": ratio(c("novel_count"), c("total_samples")),
            "novelty_of_valid": ratio(c("novel_count"), c("valid_count")),
            "repeat_rate": ratio(c("repeat_count"), c("valid_count")),
        }
    )


def run_rates(payloads: DataFrame, run: str = "config_id") -> DataFrame:
    """Counts and rates of each run, from the rows of ``by_payload``. The novel count holds repeats too."""
    return _rates(payloads.groupBy(run).agg(*_counts()))


def run_report(scored: DataFrame, run: str = "config_id") -> DataFrame:
    """``run_rates`` and the means of ``run_property_means`` of each run, in one aggregation, from scored rows of ``by_payload``."""
    return _rates(scored.groupBy(run).agg(*_counts(), *_means(F.col("n"))))


SUMMARY = ["species_scale", "groups_scale", "mic_scale", "valid_count", "novel_count", "repeat_count", "total_samples", "success_rate", "novelty_rate", "repeat_rate", "output_file"]


def summary_row(rates: DataFrame, settings: DataFrame, run: str = "config_id", on_missing: str = "null") -> DataFrame:
    """The summary table's row of each run: its scales and output file from ``settings``, counts, rates as text of two decimals.

    A run that only one side knows has a row too: without scales and file if it has no settings, with
    counts of 0 if it has no samples; or, with ``on_missing="raise"``, is an error.
    """
    counts = [c for c in SUMMARY[3:-1] if c.endswith(("_count", "_samples"))]
    rounded = {c: F.format_string("%.2f", F.coalesce(F.col(c), F.lit(0.0))) for c in ("success_rate", "novelty_rate", "repeat_rate")}
    rates = rates.select(F.col(run).alias("_run"), *SUMMARY[3:-1])
    both = settings.select(run, *SUMMARY[:3], "output_file", F.lit(True).alias("_set")).join(rates, F.col(run).eqNullSafe(F.col("_run")), "full")
    if on_missing == "raise":
        lost = F.raise_error(F.concat(F.lit("settings or samples missing for run "), F.coalesce(F.coalesce(run, "_run").cast("string"), F.lit("NULL")))).cast("long")
        both = both.withColumn("total_samples", F.when(F.col("_set") & F.col("total_samples").isNotNull(), F.col("total_samples")).otherwise(lost))
    return both.withColumns({run: F.coalesce(run, "_run"), **{c: F.coalesce(c, F.lit(0)) for c in counts}, **rounded}).select(run, *SUMMARY)


def score_samples(d: DataFrame) -> DataFrame:
    """Five scores of valid and novel rows, 0 for the others. Rows may be samples or distinct payloads."""
    mask = F.col("is_valid") & ~F.col("known")
    d = held(d.withColumn("_s", F.when(mask, F.upper("payload"))))
    s = F.col("_s")
    d = held(d.withColumn("_h", P.hydrophobicity(s)))
    h = F.col("_h")
    scores = {
        "charge_score": P.charge_score(s), "alpha_score": P.moment_of(h, 100), "beta_score": F.when(P.few_cysteines(s), 0.0).otherwise(P.moment_of(h, 160)),
        "boman_index": P.boman(s), "gravy_score": P.gravy(s),
    }
    return held(d.withColumn("scored", mask).withColumns({k: F.when(mask, v).otherwise(0.0) for k, v in scores.items()}).drop("_s", "_h"))


def _means(weight: Column | None = None) -> list[Column]:
    """Means over scored rows that count ``weight`` times each."""
    names = ["charge_score", "alpha_score", "beta_score", "boman_index", "gravy_score"]
    weight = F.lit(1) if weight is None else weight
    mass = F.sum(F.when(F.col("scored"), weight))
    return [(F.sum(F.when(F.col("scored"), F.col(n) * weight)) / mass).alias(f"mean_{n}") for n in names]


def run_property_means(scored: DataFrame, runs: DataFrame, run: str = "config_id") -> DataFrame:
    """Means over each run's scored rows, which may be those of ``by_payload``; NULL with none, or for one of ``runs`` without samples. Runs with samples that ``runs`` doesn't name have a row as well."""
    means = scored.groupBy(run).agg(*_means(F.col("n") if "n" in scored.columns else None))
    return runs.select(run).distinct().join(means, run, "full")


def attach_runs(summary: DataFrame, samples: DataFrame) -> DataFrame:
    """``summary`` with the five mean scores of each row's ``output_file``; NULL where the file is missing or has no valid, novel row.

    ``samples``: rows of those files as ``readers.read_runs`` gives them.
    """
    c = F.col
    judged_ = samples.select("output_file", c("Extracted Sequence").alias("payload"), parse_flag(c("Is Valid")).alias("is_valid"), parse_flag(c("In Training Data")).alias("known"))
    means = score_samples(judged_).groupBy("output_file").agg(*_means())
    return summary.join(means, "output_file", "left")
