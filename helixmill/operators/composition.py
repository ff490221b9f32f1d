"""Residue composition of corpora, and charge summaries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.constants import D_RESIDUES, L_RESIDUES
from helixmill.functions.barrier import held
from helixmill.functions.properties import charge_at_ph, count_of


RESIDUES = [(r, "L") for r in L_RESIDUES] + [(r, "D") for r in D_RESIDUES]


def _counts(df: DataFrame, *group: str) -> DataFrame:
    """(group, total, residue, type, n): 36 sums side by side over payloads, then a row each."""
    sums = df.groupBy(*group).agg(*[F.coalesce(F.sum(count_of(F.col("payload"), r)), F.lit(0)).cast("long").alias(f"_{i}") for i, (r, _) in enumerate(RESIDUES)])
    rows = F.array(*[F.struct(F.lit(r).alias("residue"), F.lit(t).alias("type"), F.col(f"_{i}").alias("n")) for i, (r, t) in enumerate(RESIDUES)])
    total = sum((F.col(f"_{i}") for i in range(1, len(RESIDUES))), F.col("_0")).alias("total")
    return sums.select(*group, total, F.inline(rows))


def aa_frequency(train: DataFrame, samples: DataFrame) -> DataFrame:
    """Counts and percentages of 36 residues in two corpora of payloads; NULL percentages for an empty corpus."""
    out = None
    for name, df in (("training", train), ("sampled", samples)):
        c = _counts(df)
        share = (100.0 * F.col("n") / F.nullif("total", F.lit(0))).alias(f"{name}_frequency")
        c = c.select("residue", "type", F.col("n").alias(f"{name}_count"), share)
        out = c if out is None else out.join(c.drop("type"), "residue")
    return out


def chirality_totals(payloads: DataFrame) -> DataFrame:
    """(corpus, type, n, share) over (corpus, payload); a type without residues has no row."""
    typed = _counts(payloads, "corpus").groupBy("corpus", "type").agg(F.sum("n").alias("n"), F.max("total").alias("total")).where("n > 0")
    return typed.select("corpus", "type", "n", (100.0 * F.col("n") / F.nullif("total", F.lit(0))).alias("share"))


def charge_summary(df: DataFrame, sources: list[str]) -> DataFrame:
    """Count, mean and population variance of the charge at pH 7 of each of ``sources``; an error if one has no residues."""
    d = held(df.where("residues <> ''").select("source", charge_at_ph(F.col("residues")).alias("q")))
    stats = d.groupBy("source").agg(F.count("q").alias("n"), F.avg("q").alias("mean_charge"), F.var_pop("q").alias("var_charge"))
    asked = df.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    none = F.raise_error(F.concat(F.lit("no residues in "), F.col("source"))).cast("long")
    return F.broadcast(asked).join(stats, "source", "left").withColumn("n", F.when(F.col("n").isNull(), none).otherwise(F.col("n")))
