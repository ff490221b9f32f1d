"""Unions, balanced and shuffled batches, training sets, grids and request plans."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.barrier import held
from helixmill.functions.sequences import extract_payload, is_valid, parse_flag
from helixmill.hashrand import hash_rank, uniform


def labelled_union(pos: DataFrame, neg: DataFrame) -> DataFrame:
    """(label, id, sequence): positives 1, negatives 0; the pair (label, id) is the key."""
    return pos.select(F.lit(1).alias("label"), "id", "sequence").unionByName(neg.select(F.lit(0).alias("label"), "id", "sequence"))


def balanced_batches(pos: DataFrame, neg: DataFrame, size: int, ratio: float, seed, epoch: int = 0) -> DataFrame:
    """(batch, label, id): ``int(size * ratio)`` positives a batch, the rest negatives, permuted anew when they run out.

    A short last batch of positives is dropped. With fewer negatives than a batch needs, each batch has all of them.
    """
    p = int(size * ratio)
    n = size - p
    if p == 0:
        raise ValueError("a batch needs positives")
    key = f"{seed}:{epoch}"
    batches = pos.count() // p
    chosen = hash_rank(pos.select("id"), f"{key}:pos", "id").withColumn("batch", F.floor(F.col("rank") / p))
    chosen = chosen.where(F.col("batch") < batches).select("batch", F.lit(1).alias("label"), "id")
    total = neg.count()
    if not n or not total or not batches:
        return chosen
    if total < n:
        others = neg.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))).alias("batch"), F.lit(0).alias("label"), "id")
        return chosen.unionByName(others)
    cap = total // n
    cycles = -(-batches // cap)
    spread = neg.select("id", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1))).alias("cycle"))
    ranked = hash_rank(spread, f"{key}:neg", "id", within="cycle").withColumn("k", F.floor(F.col("rank") / n))
    others = ranked.where(F.col("k") < cap).withColumn("batch", F.col("cycle") * cap + F.col("k")).where(F.col("batch") < batches)
    return chosen.unionByName(others.select("batch", F.lit(0).alias("label"), "id"))


def shuffled_batches(df: DataFrame, size: int, seed) -> DataFrame:
    return hash_rank(df.select("id"), seed, "id").select("id", F.floor(F.col("rank") / size).alias("batch"))


def training_set(amp: DataFrame | None, non_amp: DataFrame | None) -> DataFrame:
    """Distinct valid payloads of both corpora; a missing one is skipped."""
    given = [d.select(F.col(d.columns[0]).alias("s")) for d in (amp, non_amp) if d is not None]
    if not given:
        raise ValueError("no corpus")
    both = given[0] if len(given) == 1 else given[0].unionByName(given[1])
    return training_list(both, "s").distinct()


def training_list(df: DataFrame, col: str) -> DataFrame:
    """Valid payloads of a corpus, repeats kept; rows without a sequence fall out."""
    return held(df.select(extract_payload(F.col(col)).alias("payload"))).where(is_valid(F.col("payload")))


def load_for_frequency(df: DataFrame, col: str, only_valid: bool = True, flag: str = "Is Valid") -> DataFrame:
    """Valid payloads of generated samples, repeats kept; with ``only_valid`` of rows whose flag is true or 1, where there is one."""
    if only_valid and flag in df.columns:
        df = df.where(parse_flag(F.col(f"`{flag}`"), ("true", "1")))
    return training_list(df, col)


def param_grid(most: int = 10_000, **scales: DataFrame) -> DataFrame:
    """All combinations of the scales' distinct values. A scale with more than ``most`` values is an error, so what is broadcast is bounded."""
    out = None
    for name, df in scales.items():
        values = df.select(F.col(df.columns[0]).alias(name)).distinct()
        if values.limit(most + 1).count() > most:
            raise ValueError(f"{name} has more than {most} values")
        out = values if out is None else out.crossJoin(F.broadcast(values))
    return out


def request_plan(df: DataFrame, id_col: str, batch: int, mic: int, seed) -> DataFrame:
    """A generation request a row: its batch, assay bin near ``mic`` and length in [14, 36)."""
    low, high = max(0, mic - 1), min(9, mic + 1)
    return hash_rank(df, f"{seed}:order", id_col).select(
        id_col,
        F.floor(F.col("rank") / batch).alias("batch"),
        (F.floor(uniform(seed, F.lit("mic"), id_col) * (high - low + 1)) + low).cast("int").alias("mic_bin"),
        (F.floor(uniform(seed, F.lit("length"), id_col) * 22) + 14).cast("int").alias("length"),
    )
