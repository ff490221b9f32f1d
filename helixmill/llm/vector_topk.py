"""Operator 7, exact top-k search: block-at-a-time pruning.

A vector's terms are its components. Candidates stand in blocks of a range of ids; a block keeps its
matrix (the forward index) and, per component, its largest and smallest value. A query block scores
no candidate at first: per query it sums, over the components, the larger of ``q * max`` and
``q * min``, which no score in the block exceeds. It then takes the blocks by falling bound and
scores whole blocks until the next bound is below the query's k-th score.

Query blocks and groups of candidate blocks meet in pairs, each pair in one task: candidates are sent
once a query block, queries once a group. A query keeps k rows a group, so the final ranking reads
at most ``groups * k`` rows a query.

Rows: vectors that are null, or hold null or non-finite components, take no part, nor do rows without
an id; vectors of several lengths are an error. Rows with a query's own id are no candidates of it; otherwise repeated rows rank as often as
they stand. Ties go to the smaller id. Other columns are ignored; no rows give no rows. A component
or score that 64 bits can't hold is an error, never another number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm import common as C

BLOCK = "block long, ids binary, matrix binary"
HITS = "query_id long, vec_id long, score long"
EXACT = 2.0**53


def _blocks(rows: DataFrame, size: int, width: int) -> DataFrame:
    """(block, ids, matrix): vectors of one range of ids, as integers."""

    def build(table: pa.Table) -> pa.Table:
        ids = C.ints(table["id"])
        order = np.argsort(ids, kind="stable")
        values = np.asarray(table["v"].combine_chunks().flatten()).reshape(-1, width)[order]
        return pa.table(
            {"block": table["block"].slice(0, 1).combine_chunks(), "ids": pa.array([ids[order].tobytes()], pa.binary()), "matrix": pa.array([values.tobytes()], pa.binary())}
        )

    return rows.withColumn("block", F.floor(F.col("id") / size)).groupBy("block").applyInArrow(build, BLOCK)


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, candidates_per_block: int = 512, queries_per_block: int = 1024,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of floor(scale * x)."""
    spark = vectors.sparkSession

    too_large = F.raise_error(F.lit(f"a component times {scale} doesn't fit in 64 bits")).cast("double")

    def clean(df):
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
        return rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))").withColumn(
            "v", F.transform("v", lambda x: F.when(F.abs(x * scale) < 2.0**63, F.floor(x * scale).cast("double")).otherwise(too_large))
        )

    all_, asked = clean(vectors), clean(queries)
    lengths = all_.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    if lengths["low"] != lengths["high"]:
        raise ValueError(f"vectors of {lengths['low']} to {lengths['high']} components have no common product")
    width = lengths["high"] or 1
    groups = C.shuffle_width(spark)
    items = _blocks(all_, candidates_per_block, width)
    items = C.materialize(items, "vector-blocks")
    # ids that count as queries are few in a range, so ranges are dealt by a hash of the id
    wanted = C.materialize(asked, "vector-queries")
    blocks = max(1, -(-wanted.count() // queries_per_block))

    def query_blocks(table):
        ids = C.ints(table["id"])
        values = np.asarray(table["v"].combine_chunks().flatten()).reshape(-1, width)
        return pa.table({"block": table["block"].slice(0, 1).combine_chunks(), "ids": pa.array([ids.tobytes()], pa.binary()), "matrix": pa.array([values.tobytes()], pa.binary())})

    q = wanted.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long")).groupBy("block").applyInArrow(query_blocks, BLOCK)
    q = q.withColumnRenamed("block", "q").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    c = items.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    c = c.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(group, asked_: pa.Table, given: pa.Table) -> pa.Table:
        empty = pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
        if not asked_.num_rows or not given.num_rows:
            return empty
        qid = np.concatenate(C.blobs(asked_["ids"], np.int64))
        qm = np.concatenate(C.blobs(asked_["matrix"], np.float64)).reshape(-1, width)
        ids = C.blobs(given["ids"], np.int64)
        mats = [m.reshape(-1, width) for m in C.blobs(given["matrix"], np.float64)]
        top, low = np.stack([m.max(0) for m in mats]), np.stack([m.min(0) for m in mats])
        plus, minus = np.maximum(qm, 0), np.minimum(qm, 0)
        bound = plus @ top.T + minus @ low.T
        largest = max(np.abs(top).max(), np.abs(low).max()) * max(np.abs(qm).max(), 1) * width
        exact = largest < EXACT  # then doubles hold every product and sum
        if not exact:
            bound = np.full_like(bound, np.inf)  # no bound to trust; Python integers below
        order = np.argsort(-bound, axis=1, kind="stable")
        kth = np.full(len(qid), -np.inf)
        best_s = [np.zeros(0)] * len(qid)
        best_i = [np.zeros(0, np.int64)] * len(qid)
        for step in range(len(mats)):
            turn = order[:, step]
            alive = np.flatnonzero(bound[np.arange(len(qid)), turn] >= kth)
            if not len(alive):
                break
            for b in np.unique(turn[alive]):
                rows = alive[turn[alive] == b]
                if exact:
                    scores = qm[rows] @ mats[b].T
                else:
                    ints = lambda m: np.vectorize(int, otypes=[object])(m)
                    scores = ints(qm[rows]) @ ints(mats[b]).T
                for r, s in zip(rows, scores):
                    other = ids[b] != qid[r]
                    s, i = np.concatenate([best_s[r], s[other]]), np.concatenate([best_i[r], ids[b][other]])
                    if exact and len(s) > 4 * k:
                        cut = np.partition(s, len(s) - k)[len(s) - k]
                        s, i = s[s >= cut], i[s >= cut]
                    keep = np.lexsort((i, -s))[:k] if exact else np.array(sorted(range(len(s)), key=lambda t: (-s[t], i[t]))[:k], int)
                    best_s[r], best_i[r] = s[keep], i[keep]
                    if len(keep) == k:
                        kth[r] = best_s[r][-1] if exact else -np.inf
        n = [len(x) for x in best_i]
        scores = np.concatenate(best_s)
        # a score beyond 64 bits is an error of the conversion
        return pa.table({"query_id": pa.array(np.repeat(qid, n)), "vec_id": pa.array(np.concatenate(best_i)), "score": pa.array([int(x) for x in scores], pa.int64())})

    hits = q.groupBy("q", "g").cogroup(c.groupBy("q", "g")).applyInArrow(search, HITS)
    by_query = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the 10 best vectors for every vector whose id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE_SQL = """
with clean as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from clean q join clean c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs) r where rank <= 10
"""
