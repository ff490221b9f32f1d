"""A membership sketch of the training set that lasts: written once, merged when corpora are added.

The sketch is a split-block Bloom filter as a table (block, w0 .. w7, log_blocks): a key belongs to one of
``2^log_blocks`` blocks and sets one bit in each of its eight words of 64 bits. Blocks without a key have no
row. Sketches of one shape merge by OR, so a new corpus is sketched alone and added. A block is a row, so a
probe is a join by block that brings a key the eight words it needs; the table is at most ``64 * 2^log_blocks``
bytes, whatever was added, and is broadcast. A key that was added always passes. The share of other keys that
pass is known from the bits (``error_of``).
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 8
LARGEST = 19  # 2^19 blocks are 32 MB, the most that is broadcast
SCHEMA = "block int, " + ", ".join(f"w{j} long" for j in range(WORDS)) + ", log_blocks int"


def expected_error(keys: int, log_blocks: int) -> float:
    """The share of other keys that pass once ``keys`` are in, for keys spread at random over the blocks."""
    mean = keys / 2**log_blocks
    most = int(mean + 10 * math.sqrt(mean) + 20)
    weight = [math.exp(n * math.log(mean) - mean - math.lgamma(n + 1)) if mean else float(n == 0) for n in range(most)]
    return sum(w * (1 - (63 / 64) ** n) ** WORDS for n, w in enumerate(weight))


def shape_for(keys: int, error: float = 0.01) -> int:
    """``log_blocks`` of the smallest sketch that keeps within ``error``, or the largest there is."""
    return next((n for n in range(LARGEST) if expected_error(keys, n) <= error), LARGEST)


def _block(key: Column, log_blocks: int) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(key), 64 - log_blocks) if log_blocks else F.lit(0)).cast("int")


def _bit(key: Column, j: int) -> Column:
    """The key's bit in word j, 0 to 63: six bits of a second hash."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 6 * j).bitwiseAND(F.lit(63)).cast("int")


def build(keys: DataFrame, key: str, log_blocks: int) -> DataFrame:
    """The sketch of the non-null values of ``key``: one aggregation, which tasks begin before the shuffle."""
    if not 0 <= log_blocks <= LARGEST:
        raise ValueError(f"a sketch has at most 2^{LARGEST} blocks")
    rows = keys.where(F.col(key).isNotNull()).select(_block(F.col(key), log_blocks).alias("block"), *[_bit(F.col(key), j).alias(f"b{j}") for j in range(WORDS)])
    words = rows.groupBy("block").agg(*[F.bit_or(F.expr(f"shiftleft(1L, b{j})")).alias(f"w{j}") for j in range(WORDS)])
    return words.withColumn("log_blocks", F.lit(log_blocks))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sketch of both sets."""
    both = a.unionByName(b).groupBy("block", "log_blocks").agg(*[F.bit_or(f"w{j}").alias(f"w{j}") for j in range(WORDS)])
    return both.select("block", *[f"w{j}" for j in range(WORDS)], "log_blocks")


def save(sketch: DataFrame, path: str) -> None:
    sketch.write.mode("errorifexists").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def shape_of(sketch: DataFrame) -> int:
    """Its ``log_blocks``, 0 for the sketch of nothing. Sketches of different shapes in one table are an error."""
    shapes = [r[0] for r in sketch.select("log_blocks").distinct().limit(2).collect()]
    if len(shapes) > 1:
        raise ValueError("sketches of different shapes can't be one")
    return shapes[0] if shapes else 0


def error_of(sketch: DataFrame) -> float:
    """The share of keys that pass though they were never added, from the bits that are set."""
    passing = F.lit(1.0)
    for j in range(WORDS):
        passing = passing * F.bit_count(f"w{j}") / 64
    return sketch.agg(F.coalesce(F.sum(passing), F.lit(0.0))).first()[0] / 2 ** shape_of(sketch)


def probe(df: DataFrame, key: str, sketch: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: false where ``key`` was surely never added. NULL keys weren't."""
    log_blocks = shape_of(sketch)
    words = F.broadcast(sketch.select(F.col("block").alias("_block"), *[F.col(f"w{j}").alias(f"_w{j}") for j in range(WORDS)]))
    d = df.withColumn("_at", F.when(F.col(key).isNotNull(), _block(F.col(key), log_blocks))).join(words, F.col("_at") == F.col("_block"), "left")
    hit = F.col("_block").isNotNull()
    for j in range(WORDS):
        hit = hit & (F.bit_get(f"_w{j}", _bit(F.col(key), j)) == 1)
    return d.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_at", "_block", *[f"_w{j}" for j in range(WORDS)])
