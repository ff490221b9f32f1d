"""Operator 13, vector code compression: product codes by ball k-means.

Vectors become integers and are cut into equal parts; each part position has a codebook, which starts
as that part of the first vectors by id. A first pass compares with all entries. Later passes know a
part's entry of the pass before and start from its ball: the entry and the parts that it had, with
their largest distance from where the entry is now as radius. Only entries less than twice the radius
away are neighbours, for by the triangle inequality no other can be as near to any of the parts. A
part nearer than half the way to the closest neighbour is in the stable core and is done. The others
lie in rings by how many neighbours are within twice their own distance, and are compared with just
those. A neighbour at exactly twice the distance is compared too, so ties are kept and go to the lower
index: the codes are those of a full search.

Rings are taken a power of two of neighbours at a time. A ball is of the parts that a task has at
hand, which makes radii smaller, never too small.

A pass reads and writes the vectors once, and sums counts and components a task; their sums meet part
by part. Only codebooks (``parts x entries x width`` numbers) go to the driver and to all tasks.

Rows: vectors that are null, or hold null or non-finite components, are dropped. Vectors of several
lengths, of a length that ``parts`` doesn't divide, or with components beyond 32 bits once scaled are errors. Fewer vectors
than entries make a codebook of as many. Rows without an id come last in the first codebook; rows
with one id, by their components. Repeated rows count as often as they stand. Other columns are
ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm import common as C

STATE = "vec_id long, label string, ints binary, codes binary, error long, part int, counts binary, sums binary"
CODES = "vec_id long, label string, code string, error long"
SUMS = "part int, counts binary, sums binary"


# ------------------------------------------------------------------ assignment

def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of (n, w) integers to (k, w) integers, as 64-bit integers."""
    if not x.size or not entries.size:
        return np.zeros((len(x), len(entries)), np.int64)
    most = int(max(np.abs(x).max(), np.abs(entries).max()))
    bound = 4 * most * most * x.shape[1]
    if bound >= 2**62:
        raise ValueError("squared distances don't fit in 64 bits")
    if bound < 2**53:  # doubles hold every product and sum
        x, entries = x.astype(np.float64), entries.astype(np.float64)
    return ((x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)).astype(np.int64)


def full_search(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each part (ties: the lower index), its distance, and the number of distances computed."""
    d = squared(x, entries)
    near = d.argmin(1)
    return near, d[np.arange(len(x)), near], d.size


def ball_search(x: np.ndarray, entries: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The same from the entries ``own`` of the pass before, by balls, stable cores and rings."""
    gap = x - entries[own]
    if gap.size and 4 * int(np.abs(gap).max()) ** 2 * gap.shape[1] >= 2**62:
        raise ValueError("squared distances don't fit in 64 bits")
    near, distance, work = own.copy(), (gap * gap).sum(1), len(x)
    between = squared(entries, entries)
    order = np.argsort(own, kind="stable")
    cut = np.flatnonzero(np.diff(own[order], prepend=-1))
    for a, b in zip(cut.tolist(), np.append(cut[1:], len(order)).tolist()):
        rows = order[a:b]
        entry = int(own[rows[0]])
        reach = 4 * distance[rows]
        neighbours = np.flatnonzero(between[entry] <= reach.max())
        neighbours = neighbours[neighbours != entry]
        neighbours = neighbours[np.argsort(between[entry, neighbours], kind="stable")]
        ring = np.searchsorted(between[entry, neighbours], reach, side="right")
        size = 1
        while len(neighbours) and size // 2 < len(neighbours):  # rings of size // 2 + 1 to size neighbours
            some = rows[(ring > size // 2) & (ring <= size)] if size > 1 else rows[ring == 1]
            if len(some):
                rivals = np.sort(np.append(neighbours[:size], entry))
                d = squared(x[some], entries[rivals])
                best = d.argmin(1)
                near[some], distance[some] = rivals[best], d[np.arange(len(some)), best]
                work += d.size
            size *= 2
    return near, distance, work


# ------------------------------------------------------------------ passes

def _encode(books: np.ndarray, name: str, sums: bool):
    """mapInArrow function from (vec_id, label, ints[, codes]) to STATE rows; with ``sums``, a row a part at the end."""
    parts, entries, width = books.shape

    def run(batches):
        counts, totals = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            whole = np.frombuffer(b"".join(b["ints"].to_pylist()), np.int32).reshape(b.num_rows, parts, width)
            before = np.frombuffer(b"".join(b["codes"].to_pylist()), np.uint16).reshape(b.num_rows, parts) if "codes" in b.schema.names else None
            codes, error = np.zeros((b.num_rows, parts), np.uint16), np.zeros(b.num_rows, np.int64)
            step = max(1, (1 << 20) // max(1, parts * width))
            for i in range(0, b.num_rows, step):
                for p in range(parts):
                    x = whole[i : i + step, p].astype(np.int64)
                    near, d, _ = full_search(x, books[p]) if before is None else ball_search(x, books[p], before[i : i + step, p].astype(np.int64))
                    codes[i : i + step, p] = near
                    error[i : i + step] += d
                    if sums:
                        counts[p] += np.bincount(near, minlength=entries)
                        np.add.at(totals[p], near, x)
            n = b.num_rows
            bytes_ = pa.array([c.tobytes() for c in codes], pa.binary())
            none = pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], b["ints"], bytes_, pa.array(error), pa.nulls(n, pa.int32()), none, none], names=[c.split()[0] for c in STATE.split(", ")])
        if sums and counts.any():
            long_, string, bin_ = (pa.nulls(parts, t) for t in (pa.int64(), pa.string(), pa.binary()))
            rows = [long_, string, bin_, bin_, long_, pa.array(range(parts), pa.int32()), pa.array([c.tobytes() for c in counts], pa.binary()), pa.array([t.tobytes() for t in totals], pa.binary())]
            yield pa.RecordBatch.from_arrays(rows, names=[c.split()[0] for c in STATE.split(", ")])

    return run


def _added(rows: DataFrame, parts: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Counts and component sums of each part: added within tasks, then a part in one task, whose rows are one a task."""

    def fold(counts, sums):
        return sum(C.blobs(counts, np.int64)), sum(C.blobs(sums, np.int64))

    def within(batches):
        have: dict[int, list] = {}
        for b in batches:
            for p, c, s in zip(b["part"].to_pylist(), C.blobs(b["counts"], np.int64), C.blobs(b["sums"], np.int64)):
                old = have.setdefault(p, [0, 0])
                have[p] = [old[0] + c, old[1] + s]
        if have:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(have), pa.int32()), pa.array([c.tobytes() for c, _ in have.values()], pa.binary()), pa.array([s.tobytes() for _, s in have.values()], pa.binary())], names=["part", "counts", "sums"]
            )

    def across(table: pa.Table) -> pa.Table:
        c, s = fold(table["counts"], table["sums"])
        return pa.table({"part": table["part"].slice(0, 1), "counts": pa.array([c.tobytes()], pa.binary()), "sums": pa.array([s.tobytes()], pa.binary())})

    done = rows.where("part is not null").select("part", "counts", "sums").mapInArrow(within, SUMS).groupBy("part").applyInArrow(across, SUMS)
    return {r["part"]: (np.frombuffer(r["counts"], np.int64), np.frombuffer(r["sums"], np.int64)) for r in done.collect()}  # a row a part


def _moved(books: np.ndarray, added: dict) -> np.ndarray:
    books = books.copy()
    for p, (counts, sums) in added.items():
        used = counts > 0
        books[p, used] = sums.reshape(books.shape[1:])[used] // counts[used, None]
    return books


def integers(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """(vec_id, label, v): the whole vectors of finite components as integers."""
    too_large = F.raise_error(F.lit(f"a component times {scale} doesn't fit in 32 bits")).cast("int")
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return rows.withColumn("v", F.transform("v", lambda x: F.when(F.abs(x * scale) < 2.0**31 - 1, F.floor(x * scale).cast("int")).otherwise(too_large)))


def compress(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error) of every whole vector, the codebooks as (parts, entries, width) integers).

    A code has two hex digits a part, so at most 256 entries. The label is returned as text.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits has 256 entries at most")
    spark: SparkSession = vectors.sparkSession
    rows = integers(vectors, scale, id_col, vector_col, label_col)
    lengths = rows.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    if lengths["high"] is None:
        return spark.createDataFrame([], CODES), np.zeros((parts, 0, 0), np.int64)
    if lengths["low"] != lengths["high"] or lengths["high"] % parts:
        raise ValueError(f"vectors of {lengths['low']} to {lengths['high']} components can't be cut into {parts} equal parts")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()  # ``entries`` rows
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)

    def pack(batches):
        for b in batches:
            flat, sizes = b["v"].flatten().to_numpy(zero_copy_only=False).astype(np.int32), lengths["high"] * 4
            raw = flat.tobytes()
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], pa.array([raw[i * sizes : (i + 1) * sizes] for i in range(b.num_rows)], pa.binary())], names=["vec_id", "label", "ints"])

    state = rows.mapInArrow(pack, "vec_id long, label string, ints binary")
    for i in range(rounds):
        state = C.materialize(state.mapInArrow(_encode(books, f"codes-{i}", True), STATE), f"codes-{i}")
        books = _moved(books, _added(state, parts))
        state = state.where("part is null").select("vec_id", "label", "ints", "codes")
    done = state.mapInArrow(_encode(books, "codes", False), STATE)
    # entries are below 256, so the low byte of each stored number is the code
    code = F.lower(F.hex("codes"))
    code = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.substr(code, p * 4 + 1, F.lit(2))), "")
    return C.materialize(done.select("vec_id", "label", code.alias("code"), "error"), "vector-codes"), books


def label_errors(codes: DataFrame, small: int = 1 << 16) -> DataFrame:
    """``codes`` with ``label_error``, the sum of ``error`` over rows of one label, nulls together.

    Sums of at most ``small`` labels (counted first) are broadcast. Beyond, they are joined by label; both
    sides are written tables, so adaptive execution may split a label that many rows have.
    """
    sums = C.materialize(codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "label-errors")
    few = sums.count() <= small
    return codes.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("_label")), "left" if few else "inner").drop("_label")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: 16 parts, 64 entries, two rounds."""
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round(n: int) -> str:
    """SQL of one round: the nearest entry of every part, then the moved codebook."""
    dist = "list_sum(list_transform(list_zip(x.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    return f"""
near{n} as materialized (select r, p, any_value(x.v) as v, min(struct_pack(d := cast({dist} as bigint), k := k)) as best from x join book{n} b using (p) group by r, p),
sum{n} as (select p, k, i, sum(c) as s, count(*) as m from (select p, best.k as k, unnest(v) as c, unnest(range(0, len(v))) as i from near{n}) t group by p, k, i),
new{n} as (select p, k, list(cast((s - ((s % m) + m) % m) // m as bigint) order by i) as v from sum{n} group by p, k),
book{n + 1} as materialized (select b.p, b.k, coalesce(w.v, b.v) as v from book{n} b left join new{n} w on w.p = b.p and w.k = b.k),"""


ORACLE_SQL = f"""
with a as (
  select vec_id, label, list_transform(embedding, lambda e: cast(floor(256 * cast(e as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
z as materialized (select *, row_number() over (order by vec_id nulls last, v) - 1 as r from a),
x as materialized (select r, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] as v from (select r, v, unnest(range(0, 16)) as p from z) y),
book0 as materialized (select p, r as k, v from x where r < 64),{_round(0)}{_round(1)}
last as (select r, p, min(struct_pack(d := cast(list_sum(list_transform(list_zip(x.v, b.v), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) as bigint), k := k)) as best from x join book2 b using (p) group by r, p),
done as (select r, string_agg(printf('%02x', best.k), '' order by p) as code, cast(sum(best.d) as bigint) as error from last group by r),
books as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, k)) as codebooks_sha256 from book2)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from done join z using (r) cross join books
"""
