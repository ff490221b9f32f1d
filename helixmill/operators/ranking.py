"""Normalisation, utilities and choices."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill import constants as K
from helixmill.functions.barrier import held
from helixmill.functions.properties import charge_at_ph, diversity
from helixmill.functions.sequences import clean_residues, tokenize


def gravy_desirability(df: DataFrame) -> DataFrame:
    return df.withColumn("s_gravy", F.exp(-F.pow(F.col("mean_gravy_score") - K.GRAVY_TARGET, F.lit(2.0)) / (2 * K.GRAVY_SIGMA**2)))


def minmax(df: DataFrame, cols: list[str]) -> DataFrame:
    """Adds ``norm_<col>``; NULL for a constant column."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    d = df.crossJoin(F.broadcast(stats))
    span = lambda c: F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
    return d.withColumns({f"norm_{c}": F.when(span(c) != 0, (F.col(c) - F.col(f"_lo_{c}")) / span(c)) for c in cols}).drop(*[f"_{n}_{c}" for c in cols for n in ("lo", "hi")])


def utilities(df: DataFrame) -> DataFrame:
    """``utility_<profile>``: weighted sums of normalised metrics and the desirability of GRAVY."""
    d = minmax(gravy_desirability(df), K.LINEAR_METRICS)
    d = d.withColumn("norm_repeat_rate_inv", 1.0 - F.col("norm_repeat_rate"))
    secondary = sum((w * F.col(f"norm_{c}") for c, w in K.SECONDARY_WEIGHTS.items()), F.lit(0.0))
    value = lambda c: F.col(c if c == "s_gravy" else f"norm_{c}")
    return d.withColumns({f"utility_{p}": sum((w * value(c) for c, w in ws.items()), secondary) for p, ws in K.PROFILE_WEIGHTS.items()})


SCALES = ["species_scale", "groups_scale", "mic_scale"]


def top_settings(df: DataFrame, k: int = 5) -> DataFrame:
    """The k best settings of every profile; ties go to the smaller scales."""
    d = utilities(df)
    stacked = d.select("*", F.explode(F.map_from_arrays(F.array(*[F.lit(p) for p in K.PROFILE_WEIGHTS]), F.array(*[F.col(f"utility_{p}") for p in K.PROFILE_WEIGHTS]))).alias("profile", "utility"))
    order = Window.partitionBy("profile").orderBy(F.col("utility").desc_nulls_last(), *SCALES)
    metrics = [*K.LINEAR_METRICS[:4], "mean_gravy_score", *K.LINEAR_METRICS[4:]]
    return stacked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("profile", "rank", *SCALES, *metrics, "utility")


def candidate_residues(df: DataFrame) -> DataFrame:
    """Adds ``residues``: the first ``length`` tokens, two cut from either end if over four, letters only."""
    t = F.slice(tokenize(F.col("candidate")), F.lit(1), F.col("length"))
    inner = F.when(F.size("_t") > 4, F.slice("_t", F.lit(3), F.size("_t") - 4)).otherwise(F.col("_t"))
    return held(held(df.withColumn("_t", t)).withColumn("residues", clean_residues(F.array_join(inner, ""))).drop("_t"))


def best_of_k(df: DataFrame, low: float = 2.0, high: float = 9.0) -> DataFrame:
    """Of an item's candidates the most diverse with a charge in [low, high]; the first on ties; candidate 0 if none has."""
    d = held(candidate_residues(df).withColumn("charge", charge_at_ph(F.col("residues"))))
    d = held(d.withColumn("eligible", F.coalesce(F.col("charge").between(low, high), F.lit(False))))
    d = held(d.withColumn("_v", F.when(F.col("eligible"), F.round(diversity(F.col("residues")), 6)).otherwise(0.0)))
    best = d.groupBy("item_id").agg(F.max_by(F.struct("k", "residues", "eligible"), F.struct("eligible", "_v", -F.col("k"))).alias("b"))
    return best.select("item_id", "b.k", "b.residues", "b.eligible")
