"""Randomness by keyed hash: the same for retried tasks and any partitioning."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.session import scratch


def digest(seed, *keys) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]).cast("binary"))


def uniform(seed, *keys) -> Column:
    """u in [0, 1) from the first 32 bits of md5('seed:key:...')."""
    return F.conv(F.substring(digest(seed, *keys), 1, 8), 16, 10).cast("double") / 4294967296.0


def draws(prefix: Column, n: Column) -> Column:
    """Digests with ``n`` draws of 32 bits, four a digest: draw i is the (i mod 4)-th eight hex digits of md5(prefix || i div 4)."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 4).cast("int")), lambda b: F.md5(F.concat(prefix, b.cast("string")).cast("binary")))
    return F.when(n > 0, blocks).otherwise(F.array().cast("array<string>"))


UNROLLED = 17  # digests that are compiled expressions: what a text of MAX_LENGTH tokens needs


def draw_text(prefix: Column, n: Column) -> Column:
    """``draws`` end to end, as one text of eight hex digits a draw. A lambda runs only for draws that ``UNROLLED`` digests don't hold."""
    block = lambda b: F.md5(F.concat(prefix, b).cast("binary"))
    more = F.transform(F.sequence(F.lit(UNROLLED), F.floor((n - 1) / 4).cast("int")), lambda b: block(b.cast("string")))
    return F.concat_ws("", *[F.when(n > 4 * b, block(F.lit(str(b)))) for b in range(UNROLLED)], F.when(n > 4 * UNROLLED, F.array_join(more, "")))


def draw_below(digests: Column, i: Column, bar: Column) -> Column:
    """Whether draw ``i`` of ``draws`` lies below a chance, given as ``bar_of`` that chance. Fixed-width hex digits order as numbers do."""
    return F.substring(F.get(digests, F.floor(i / 4).cast("int")), (i % 4) * 8 + 1, F.lit(8)) < bar


def bar_of(chance: Column) -> Column:
    """The least 32-bit draw that isn't below ``chance``, as eight hex digits; ``g`` if there is none."""
    least = F.ceil(chance * 4294967296.0)
    return F.when(least >= 4294967296, "g").otherwise(F.lower(F.lpad(F.hex(F.greatest(least, F.lit(0))), 8, "0")))


RANGE_ROWS = 50_000  # rows that one range holds on average


def hash_rank(df: DataFrame, seed, id_col: str, within: str | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``rank`` from 0 in the order of (md5(seed[:within]:id), id), without one task that sees all rows.

    Rows are written with their hash and numbered inside ranges of it. Hashes are even, so the number of ranges, a power
    of 16, follows from the row count and needs no sample. Prefix sums are taken in two levels, so the sums of any one
    task are over at most 4096 ranges or over those of one of them.
    """
    keys = [within, id_col] if within else [id_col]
    group = [within] if within else []
    path = scratch(df.sparkSession, "hashed")
    hashed = df.withColumn("_h", F.unhex(digest(seed, *keys)))  # 16 bytes, in the order of their hex digits
    hashed.write.parquet(path)
    d = df.sparkSession.read.schema(hashed.schema).parquet(path)
    rows, digits = d.count(), 1
    while 16**digits * range_rows < rows and digits < 8:
        digits += 1
    coarse = min(3, digits)
    d = d.withColumn("_b", F.lower(F.substring(F.hex(F.substring("_h", 1, 4)), 1, digits)))
    counts = d.groupBy(*group, "_b").agg(F.count("*").alias("_n")).withColumn("_c", F.substring("_b", 1, coarse))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    fine = counts.withColumn("_within", F.coalesce(F.sum("_n").over(before(*group, "_c").orderBy("_b")), F.lit(0)))
    above = counts.groupBy(*group, "_c").agg(F.sum("_n").alias("_m"))
    above = above.select(*group, "_c", F.coalesce(F.sum("_m").over(before(*group).orderBy("_c")), F.lit(0)).alias("_above"))
    first = fine.join(above, [*group, "_c"]).select(*group, "_b", (F.col("_within") + F.col("_above")).alias("_first"))
    inside = Window.partitionBy(*group, "_b").orderBy("_h", id_col)
    d = d.withColumn("_r", F.row_number().over(inside)).join(first, [*group, "_b"])
    return d.withColumn("rank", F.col("_first") + F.col("_r") - 1).drop("_h", "_b", "_r", "_first")
