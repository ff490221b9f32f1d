"""Exact order statistics and ranks of large tables, without a buffer of all values and without a task that sees all rows.

``order_statistics`` narrows brackets: a mergeable sketch of bounded size names two values near each wanted
rank, one aggregation counts what lies below and at them, and the bracket that holds the rank goes on, until its
rows are few enough for one task. Bracket ends are values of the table and are left out of the next
bracket, so each round makes progress, however often a value repeats.

``ranked`` sorts by ranges and adds prefix sums of their counts. There are as many ranges as the sort has
partitions, which grow with the rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.session import scratch

TASK_ROWS = 1_000_000  # values that one task sorts
SKETCH = 1000  # accuracy of the sketch: ends lie within a few thousandths of the bracket's rows around the rank
SMALL = 100_000  # rows of a range table that are broadcast


@dataclass
class _Bracket:
    """Values strictly between ``low`` and ``high`` (None: without end), of which ``rows`` stand after ``before`` lower ones."""

    low: float | None
    high: float | None
    before: int
    rows: int
    ranks: list[int] = field(default_factory=list)

    def holds(self, c: Column) -> Column:
        inside = F.lit(True) if self.low is None else c > self.low
        return inside if self.high is None else inside & (c < self.high)


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def order_statistics(df: DataFrame, col: str, ranks: list[int] | None = None, fractions: list[float] | None = None, task_rows: int = TASK_ROWS) -> tuple[int, dict[int, float]]:
    """(count, value by rank from 0) of the non-null values of ``col`` as doubles, NaN being the largest.

    ``fractions`` asks for the two ranks around each position ``fraction * (count - 1)``; ranks beyond the
    rows have no entry. Jobs run at once; what goes to the driver is a few numbers a rank. The column is written
    first, so its expression is computed once, not once a round.
    """
    values = _written(df.select(F.col(col).cast("double").alias("v")).where("v is not null"), "values")
    v = F.col("v")
    total = values.count()
    wanted = set(ranks or [])
    for f in fractions or []:
        at = (total - 1) * f
        wanted |= {int(at), min(total - 1, int(at) + 1)}
    wanted = sorted(r for r in wanted if 0 <= r < total)
    found: dict[int, float] = {}
    open_ = [_Bracket(None, None, 0, total, wanted)] if wanted else []
    while any(b.rows > task_rows for b in open_):
        large = [b for b in open_ if b.rows > task_rows]
        small = [b for b in open_ if b.rows <= task_rows]
        asked = [(b, r, min(1.0, max(0.0, (r - b.before + 0.5) / b.rows))) for b in large for r in b.ranks]
        # the two ends around each wanted rank, from one sketch a bracket
        sketches = []
        for b in large:
            points = sorted({min(1.0, max(0.0, p + d)) for a, _, p in asked if a is b for d in (-2 / SKETCH, 2 / SKETCH)})
            sketches.append(F.percentile_approx(F.when(b.holds(v), v), points, SKETCH).alias(f"s{len(sketches)}"))
        ends = [sorted(set(x or [])) for x in values.agg(*sketches).first()]
        counts = [c for b, e in zip(large, ends) for x in e for c in (F.count_if(b.holds(v) & (v < x)), F.count_if(b.holds(v) & (v <= x)))]
        seen = iter(values.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)]).first())
        for b, e in zip(large, ends):
            cuts = [(x, b.before + next(seen), b.before + next(seen)) for x in e]  # value, rows below, rows up to it
            low, start = b.low, b.before
            for x, below, upto in [*cuts, (b.high, b.before + b.rows, None)]:
                inside = [r for r in b.ranks if start <= r < below]
                if inside:
                    small.append(_Bracket(low, x, start, below - start, inside))
                if upto is not None:
                    found |= {r: x for r in b.ranks if below <= r < upto}
                    low, start = x, upto
        open_ = small
    if open_:
        which = F.coalesce(*[F.when(b.holds(v), F.lit(i)) for i, b in enumerate(open_)])
        rows = values.select("v", which.alias("b")).where("b is not null").groupBy("b", "v").agg(F.count("*").alias("n"))
        upto = Window.partitionBy("b").orderBy("v")
        rows = rows.withColumn("end", F.sum("n").over(upto)).withColumn("begin", F.col("end") - F.col("n"))
        hit = [(F.col("b") == i) & (F.col("begin") <= r - b.before) & (F.col("end") > r - b.before) for i, b in enumerate(open_) for r in b.ranks]
        some = hit[0]
        for h in hit[1:]:
            some = some | h
        for row in rows.where(some).collect():  # a row a wanted rank at most
            b = open_[row["b"]]
            found |= {r: row["v"] for r in b.ranks if row["begin"] <= r - b.before < row["end"]}
    return total, found


def quantiles(df: DataFrame, col: str, fractions: list[float], task_rows: int = TASK_ROWS) -> list[float] | None:
    """Linear-interpolated quantiles, to the last bit those of ``percentile``; None without values."""
    total, at = order_statistics(df, col, fractions=fractions, task_rows=task_rows)
    if not total:
        return None
    out = []
    for f in fractions:
        place = (total - 1) * f
        low, high = int(place), min(total - 1, int(place) + 1)
        a, b = at[low], at[high]
        out.append(a if place == low or a == b else (low + 1 - place) * a + (place - low) * b)
    return out


def ranked(df: DataFrame, order: list[str], within: str | None = None, rank: str = "rank", size: str | None = None) -> DataFrame:
    """Adds ``rank`` from 0 by ``order`` (in each value of ``within``), and the number of rows there as ``size``.

    Rows are sorted by ranges of (within, order) and written with their place in the range; each range and value of
    ``within`` then needs the number of rows before it, which are sums over as many rows as there are ranges. Rows that
    ``order`` doesn't tell apart are ranked in any order. No group is one task's, and rows are shuffled once.
    """
    group = [within] if within else []
    keys = [*group, *order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_mark", F.monotonically_increasing_id())
    rows = _written(rows.withColumns({"_part": F.shiftright("_mark", 33), "_at": F.col("_mark").bitwiseAND(2**33 - 1)}).drop("_mark"), "ranges")
    ranges = rows.groupBy("_part", *group).agg(F.count("*").alias("_n"), F.min("_at").alias("_start"))
    by = Window.partitionBy(*group)
    before = by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = ranges.select(F.col("_part").alias("_p"), *[F.col(g).alias("_g") for g in group], (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_start")).alias("_first"), F.sum("_n").over(by).alias("_size"))
    first = _written(first, "range-starts")
    if first.count() <= SMALL:
        first = F.broadcast(first)
    same = F.col("_part") == F.col("_p")
    if within:
        same = same & F.col(within).eqNullSafe(F.col("_g"))
    out = rows.join(first, same).withColumn(rank, F.col("_first") + F.col("_at"))
    if size:
        out = out.withColumn(size, F.col("_size"))
    return out.drop("_part", "_at", "_p", "_g", "_first", "_size")
