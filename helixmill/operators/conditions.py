"""Condition vectors, quantile bins and normalisation."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.constants import GROUPS, OBJECTS, SPECIES
from helixmill.operators.order_statistics import quantiles


def parse_list(text: Column) -> Column:
    """A single-quoted list as an array."""
    return F.from_json(text, "array<string>")


def multi_hot(values: Column, names: list[str]) -> Column:
    return F.array(*[F.array_contains(values, n).cast("double") for n in names])


def one_hot(index: Column, dim: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (i == index).cast("double"))


def spec_vector(spec: Column, dim: int) -> Column:
    """Multi-hot of an array of indices; zeros for an empty one."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.array_contains(spec, i).cast("double"))


def _known(values: Column, names: list[str], what: str) -> Column:
    """``values``, or an error if it holds a name that isn't known."""
    ok = F.forall(values, lambda v: v.isin(*names))
    return F.when(ok, values).otherwise(F.raise_error(F.lit(f"unknown {what}")).cast("array<string>"))


def condition_vector(df: DataFrame) -> DataFrame:
    """Adds ``condition``: species (6), groups (5), objects (5), assay bin (10). Needs ``bin``."""
    species = F.element_at(_known(F.array("species"), SPECIES, "species"), 1)
    parts = [F.array(*[(species == n).cast("double") for n in SPECIES])]
    parts.append(multi_hot(_known(parse_list(F.col("target_groups_text")), GROUPS, "group"), GROUPS))
    parts.append(multi_hot(_known(parse_list(F.col("target_objects_text")), OBJECTS, "object"), OBJECTS))
    parts.append(one_hot(F.col("bin"), 10))
    return df.withColumn("condition", F.concat(*parts))


def decode_conditions(df: DataFrame, edges: Column) -> DataFrame:
    """Adds species, groups, objects and the assay range of ``condition``; ``edges`` is the array of bin edges."""

    def names(start: int, labels: list[str]) -> Column:
        marked = F.transform(F.slice("condition", start + 1, len(labels)), lambda x, i: F.when(x == 1.0, F.element_at(F.array(*map(F.lit, labels)), i + 1)))
        return F.filter(marked, lambda x: x.isNotNull())

    bin_ = F.array_position(F.slice("condition", 17, 10), 1.0).cast("int") - 1
    edge = lambda i: F.try_element_at(edges, i + 1)
    low = F.when(bin_ == 0, F.lit(0.0)).when(bin_ == 9, edge(bin_)).when(bin_ > 0, edge(bin_ - 1))
    high = F.when(bin_ == 9, edge(bin_) * 5).when(bin_ >= 0, edge(bin_))
    return df.withColumns(
        {"species": F.try_element_at(names(0, SPECIES), F.lit(1)), "groups": names(6, GROUPS), "objects": names(11, OBJECTS), "mic_low": low, "mic_high": high}
    )


def quantile_edges(df: DataFrame, col: str, q: int = 10, approximate: bool = False) -> list[float] | None:
    """The q + 1 linear-interpolated quantiles of ``col``, exact at any size (``order_statistics``); None without values.

    ``approximate``: values of the table near them instead, from one pass.
    """
    steps = [i / q for i in range(q + 1)]
    if approximate:
        return df.agg(F.percentile_approx(F.col(col), steps, 100000)).first()[0]
    return quantiles(df, col, steps)


def quantile_bin(df: DataFrame, col: str, q: int = 10, dup: str = "raise") -> DataFrame:
    """Adds ``bin`` (right-closed, lowest included; NULL for a NULL value) and ``edges``. Edges that repeat are an error, or with ``dup="drop"`` count once."""
    edges = quantile_edges(df, col, q)
    if edges is None:
        return df.withColumns({"bin": F.lit(None).cast("int"), "edges": F.lit(None).cast("array<double>")})
    if dup == "drop":
        edges = sorted(set(edges))
    elif len(set(edges)) < len(edges):
        raise ValueError("bin edges must be unique")
    below = sum((F.when(F.col(col) > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
    bin_ = F.when(F.col(col).isNotNull(), F.greatest(below - 1, F.lit(0)))
    return df.withColumns({"bin": bin_.cast("int"), "edges": F.array(*map(F.lit, edges))})


def log_zscore(df: DataFrame, col: str) -> DataFrame:
    """Adds ``norm``: the sample z-score of ln(x + 1e-6), with its mean, std, min and max."""
    x = F.log(F.col(col) + 1e-6)
    stats = df.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    scale = lambda v: F.when(F.col("std") != 0, (v - F.col("mean")) / F.col("std"))
    d = df.crossJoin(F.broadcast(stats))
    return d.withColumns({"norm": scale(x), "norm_min": scale(F.col("_lo")), "norm_max": scale(F.col("_hi"))}).drop("_lo", "_hi")


def negative_condition(df: DataFrame, mode: str = "constant", seed: int = 42, id_col: str | None = None) -> DataFrame:
    """Condition of an inactive sequence: one species and one bin, no groups or objects."""
    from helixmill.hashrand import uniform

    if mode == "constant":
        species, bin_ = F.lit(3), F.lit(7)
    else:
        species, bin_ = F.floor(uniform(seed, F.lit("species"), id_col) * 6).cast("int"), F.floor(uniform(seed, F.lit("bin"), id_col) * 10).cast("int")
    return df.withColumn("condition", F.concat(one_hot(species, 6), F.array_repeat(F.lit(0.0), 10), one_hot(bin_, 10)))


def upper_triangle(maps: DataFrame) -> DataFrame:
    return maps.where("i < j")


SPECIALS = ["MASK", "blank", "SOS", "EOS"]


def distance_dictionary(maps: DataFrame, q: int = 10, approximate: bool = False) -> DataFrame:
    """(bin_id, edge): 0 and the pooled quantile edges over all pairs of all maps, the last one too. Edges that repeat count once."""
    pairs = upper_triangle(maps)
    edges = [0.0, *sorted(set(quantile_edges(pairs, "d", q, approximate) or []))]
    return maps.sparkSession.createDataFrame(list(enumerate(edges)), "bin_id int, edge double")


def distance_ids(dictionary: DataFrame) -> DataFrame:
    """(bin_id, edge, special): the ids of a dictionary's edges but the last, then the four special ids."""
    n = dictionary.agg(F.max("bin_id").alias("_last"))
    rows = dictionary.crossJoin(F.broadcast(n)).where("bin_id < _last").select("bin_id", "edge", F.lit(None).cast("string").alias("special"))
    special = n.select(F.posexplode(F.array(*map(F.lit, SPECIALS))).alias("k", "special"), "_last")
    return rows.unionByName(special.select((F.col("_last") + F.col("k")).alias("bin_id"), F.lit(None).cast("double").alias("edge"), "special"))


def distance_bins(maps: DataFrame, q: int = 10, approximate: bool = False) -> DataFrame:
    """The id table of the maps' dictionary."""
    return distance_ids(distance_dictionary(maps, q, approximate))
