"""Long tables of token scores (item_id, pos, token_id, score) after a model has run."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.hashrand import uniform


def blend_scores(df: DataFrame, scales: dict[int, float], temperature: float = 1.0, by_position: bool = False) -> DataFrame:
    """u + sum of s_k (l_k - u) over the conditional passes k, by temperature; pass 0 is u. One aggregation, no join.

    ``by_position``: deal the rows out by position first, so that what a position needs next (softmax, a draw) isn't shuffled again.
    """
    if by_position:
        df = df.repartition("item_id", "pos")
    u = F.max(F.when(F.col("pass") == 0, F.col("score")))
    total = u
    for k, s in scales.items():
        total = total + s * (F.max(F.when(F.col("pass") == k, F.col("score"))) - u)
    return df.groupBy("item_id", "pos", "token_id").agg((total / temperature).alias("score"))


def softmax_scores(df: DataFrame, exclude: list[int]) -> DataFrame:
    """Adds ``p`` among the tokens that aren't excluded."""
    d = df.where(~F.col("token_id").isin(*exclude)) if exclude else df
    place = Window.partitionBy("item_id", "pos")
    d = d.withColumn("_e", F.exp(F.col("score") - F.max("score").over(place)))
    return d.withColumn("p", F.col("_e") / F.sum("_e").over(place)).drop("_e")


def draw_category(df: DataFrame, seed, temperature: float = 1.0) -> DataFrame:
    """One token a position by Gumbel-max over ln p."""
    u = uniform(seed, "item_id", "pos", "token_id")
    gumbel = -F.log(-F.log(u + 1e-10) + 1e-10)
    # rounded, so that the last bits of a logarithm don't decide
    value = F.round(F.log(F.col("p") + 1e-10) / temperature + gumbel, 9)
    return df.groupBy("item_id", "pos").agg(F.max_by("token_id", F.struct(value, -F.col("token_id"))).alias("token_id"))
