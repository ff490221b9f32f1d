"""Token corruption for masked training."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.functions.arrays import spread, text_bytes
from helixmill.functions.barrier import held
from helixmill.hashrand import draw_text, uniform
from helixmill.operators.order_statistics import ranked

EPS = 1e-3


def _masked(ids: Column, draws: Column, least: Column, mask_id: int, pad_id: int | None) -> Column:
    """``ids`` with ``mask_id`` where the position's draw (``draw_text``) is below ``least``, a batch of rows at a time."""

    @F.arrow_udf("array<int>")
    def run(ids: pa.Array, draws: pa.Array, least: pa.Array) -> pa.Array:
        size = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        row, i = spread(size)
        digits, offsets = text_bytes(draws)
        draw = np.frombuffer(bytes.fromhex(digits.tobytes().decode()), ">u4")
        at, has = offsets[:-1][row] // 8 + i, i < (np.diff(offsets) // 8)[row]
        hit = has.copy()
        hit[has] = draw[at[has]] < least.fill_null(0).to_numpy(zero_copy_only=False)[row[has]]
        flat = ids.flatten()
        known = flat.is_valid().to_numpy(zero_copy_only=False)
        value = flat.fill_null(0).to_numpy(zero_copy_only=False)
        if pad_id is not None:
            hit &= known & (value != pad_id)
        values = pa.array(np.where(hit, mask_id, value).astype(np.int32), mask=None if known.all() else ~(known | hit))
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), values, mask=ids.is_null() if ids.null_count else None)

    return run(ids, draws, least)


def _mask(df: DataFrame, chance: Column, mask_id: int, pad_id: int | None, seed, id_col: str) -> DataFrame:
    """Position i is masked if its draw is below ``chance``. A digest serves four positions; pads at the end cost none."""
    last = F.size("ids")
    if pad_id is not None:  # where all pads stand at the end
        tokens = F.size(F.array_remove("ids", pad_id))
        last = F.when(F.array_position("ids", pad_id) == tokens + 1, tokens).otherwise(last)
    d = held(df.withColumn("_last", last))
    prefix = F.concat(F.lit(f"{seed}:pos:"), F.col(id_col).cast("string"), F.lit(":"))
    d = held(d.withColumns({"_prefix": prefix, "_least": F.ceil(chance * 4294967296.0)}))
    d = d.withColumn("masked", _masked(F.col("ids"), draw_text(F.col("_prefix"), F.col("_last")), F.col("_least"), mask_id, pad_id))
    d = held(d.drop("_last", "_prefix", "_least"))
    return d.withColumn("is_masked", F.transform("masked", lambda x: x == mask_id))


def mask_tokens(df: DataFrame, mask_id: int, pad_id: int, seed, id_col: str) -> DataFrame:
    """Each token but pads becomes ``mask_id`` with probability 1 - t, t uniform a row."""
    d = df.withColumn("t", uniform(seed, F.lit("t"), id_col))
    return _mask(d, 1 - F.col("t"), mask_id, pad_id, seed, id_col)


def noise_schedule(t: Column, eps: float = EPS) -> tuple[Column, Column]:
    """Total noise and its rate at ``t``."""
    return -F.log1p(-(1 - eps) * t), F.lit(1 - eps) / (1 - (1 - eps) * t)


def mask_loglinear(df: DataFrame, mask_id: int, seed, id_col: str) -> DataFrame:
    """Log-linear schedule; pads are not protected. Adds ``t``, ``sigma``, ``rate``."""
    d = df.withColumn("t", uniform(seed, F.lit("t"), id_col))
    sigma, rate = noise_schedule(F.col("t"))
    d = d.withColumn("sigma", sigma).withColumn("rate", rate)
    return _mask(d, 1 - F.exp(-F.col("sigma")), mask_id, None, seed, id_col)


def stratified_t(df: DataFrame, batch_col: str, id_col: str, seed) -> DataFrame:
    """One draw a stratum of the batch, in [1e-3, 1). Strata follow the order of ids; no batch is one task's."""
    d = ranked(df, [id_col], batch_col, "_i", "_n")
    return d.withColumn("t", (uniform(seed, id_col) / F.col("_n") + F.col("_i") / F.col("_n")) % 1 * (1 - EPS) + EPS).drop("_i", "_n")


def condition_dropout(df: DataFrame, p: float, seed, id_col: str) -> DataFrame:
    return df.withColumns({f"drop_{c}": uniform(seed, F.lit(c), id_col) < p for c in ("species", "groups", "mic")})


def masked_nll(scores: DataFrame, targets: DataFrame, exclude: list[int], pad_id: int) -> DataFrame:
    """One row: mean negative log-likelihood over masked positions whose target isn't a pad; 0 with none.

    ``scores`` (item_id, pos, token_id, score); ``targets`` (item_id, pos, target, is_masked), one row a position.
    """
    losses = _losses(scores, targets.where(F.col("is_masked") & (F.col("target") != pad_id)), exclude)
    return losses.agg(F.coalesce(F.sum("loss") / F.nullif(F.count("loss"), F.lit(0)), F.lit(0.0)).alias("nll"), F.count("loss").alias("n_positions"))


def log_sum_exp(scores: Column) -> Column:
    """ln of the sum of exp over an array, by its largest value; NULL values don't count, and an array without others gives NULL."""
    top = F.array_max(scores)
    return top + F.log(F.aggregate(scores, F.lit(0.0), lambda z, x: z + F.coalesce(F.exp(x - top), F.lit(0.0))))


def _losses(scores: DataFrame, targets: DataFrame, exclude: list[int]) -> DataFrame:
    """(item_id, pos, loss): negative log-likelihood of each target among the tokens that aren't excluded.

    Scores and targets are one table that is grouped once, so there is no join: a position's scores
    (a vocabulary at most) meet its target in one list. Positions without scores or target have no row.
    """
    usable = scores.where(~F.col("token_id").isin(*exclude)) if exclude else scores
    score = F.struct("token_id", F.col("score").cast("double").alias("score"))
    none = F.lit(None).cast("struct<token_id: int, score: double>")
    rows = usable.select("item_id", "pos", score.cast("struct<token_id: int, score: double>").alias("s"), F.lit(None).cast("int").alias("t"))
    rows = rows.unionByName(targets.select("item_id", "pos", none.alias("s"), F.col("target").cast("int").alias("t")))
    one = rows.groupBy("item_id", "pos").agg(F.collect_list("s").alias("s"), F.max("t").alias("target")).where("target is not null and size(s) > 0")
    hit = F.array_max(F.transform(F.filter("s", lambda x: x["token_id"] == F.col("target")), lambda x: x["score"]))
    return held(one).select("item_id", "pos", (log_sum_exp(F.transform("s", lambda x: x["score"])) - hit).alias("loss"))


def position_nll(scores: DataFrame, targets: DataFrame, mask_id: int, weight: float = 1.5) -> DataFrame:
    """One row over all positions, masked or not: mean negative log-likelihood without the mask token, and ``weight`` times it."""
    nll = F.avg("loss")
    return _losses(scores, targets, [mask_id]).agg(nll.alias("nll"), (weight * nll).alias("total"), F.count("loss").alias("n_positions"))
