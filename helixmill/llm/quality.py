"""Operator 5, quality classifier: nearest-neighbour voting among latent-semantic vectors.

A text's features are hashed counts of its words, of its words' shapes (runs of lower case, upper
case, digits and each other sign), and of repetition (a word like the one before it, five words that
stood in the text already). Document frequencies cover all documents. A truncated SVD of the tf-idf
matrix of a bounded, class-balanced sample of labelled rows (``max_bytes`` each at most) gives the latent space; its vectors are
broadcast (``2 * per_class`` rows of ``rank`` numbers, whatever the data). Every document is
compared with all of them by exact cosine, block by block, and the ``k`` nearest vote with weights
that grow with their similarity.

Rows: a text without words (null, empty) is near nothing and scores the labels' mean in the sample.
All rows are scored, repeated ones alike; other columns are ignored; without labels scores are 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm import common as C
from helixmill.llm.labelled import held_out, sample, score_batches

U64 = np.uint64
SHAPES, WORDS = 2048, 1024
DIM = SHAPES + WORDS + 2
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def _counts(data: np.ndarray, offsets: np.ndarray):
    """(row, feature, count), sorted, and the number of words of every row."""
    n = len(offsets) - 1
    start, end, row = C.words_of(data, offsets)
    words = np.bincount(row, minlength=n)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z, words
    kind = _SHAPE[data]
    first = np.zeros(len(data), bool)
    first[0] = True
    first[1:] = kind[1:] != kind[:-1]
    first[start] = True
    where = np.flatnonzero(first)
    shape = C.span_hash(C.prefix_hash(kind[where]), np.searchsorted(where, start), np.searchsorted(where, end))
    low = C.lower_ascii(data)
    word = C.span_hash(C.prefix_hash(low), start, end)
    again = np.flatnonzero((row[1:] == row[:-1]) & (word[1:] == word[:-1])) + 1
    shingle_row, _ = C.shingle_sets(low, offsets)
    distinct = np.bincount(shingle_row, minlength=n)
    repeated = np.maximum(np.maximum(words - 4, (words > 0).astype(int)) - distinct, 0)
    key = np.concatenate([row * DIM + (shape % U64(SHAPES)).astype(np.int64), row * DIM + SHAPES + (word % U64(WORDS)).astype(np.int64), row[again] * DIM + DIM - 2])
    key, count = np.unique(key, return_counts=True)
    some = np.flatnonzero(repeated)
    key, count = np.concatenate([key, some * DIM + DIM - 1]), np.concatenate([count, repeated[some]])
    order = np.argsort(key)
    key, count = key[order], count[order]
    return key // DIM, key % DIM, count, words


def _weights(data, offsets, idf):
    """(row, feature, weight), sorted; words count less than shapes and repetition."""
    row, feature, count, words = _counts(data, offsets)
    weight = np.where((feature >= SHAPES) & (feature < SHAPES + WORDS), 0.25, 1.0) * idf[feature]
    return row, feature, np.sqrt(count / words[row]) * weight


def _vectors(data, offsets, idf) -> np.ndarray:
    """Dense rows of weighted features."""
    row, feature, weight = _weights(data, offsets, idf)
    x = np.zeros((len(offsets) - 1, DIM), np.float32)
    x[row, feature] = weight
    return x


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """How many of all documents have each of the hashed features, and how many documents there are."""

    def count(batches):
        total, n = np.zeros(DIM, np.int64), 0
        for b in batches:
            data, offsets = C.text_bytes(b.column(0))
            n += b.num_rows
            for i, j in C.slices(offsets):
                _, f, _, _ = _counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                total += np.bincount(f, minlength=DIM)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["f", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIM, np.int64)
    for r in rows:  # DIM + 1 rows at most
        if r["f"] >= 0:
            df[r["f"]] = r["n"]
    return df, max([1, *(r["n"] for r in rows if r["f"] < 0)])


class Model:
    def __init__(self, idf, space, near, y, k):
        self.idf, self.space, self.near, self.y, self.k = idf, space, near, y, k

    def project(self, x):
        z = x @ self.space
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, data, offsets, block=1024):
        n = len(offsets) - 1
        out = np.full(n, float(self.y.mean()) if len(self.y) else 0.5)
        if not len(self.y):
            return out
        for lo in range(0, n, block):
            o = offsets[lo : lo + block + 1]
            z = self.project(_vectors(data[o[0] : o[-1]], o - o[0], self.idf))
            sims = z @ self.near.T
            k = min(self.k, len(self.y))
            at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(sims, at, axis=1), 0).astype(np.float64) ** 8
            total = w.sum(1)
            some = total > 1e-12
            out[lo : lo + block][some] = ((w * self.y[at]).sum(1)[some] / total[some]).clip(0, 1)
        return out


def train(docs: DataFrame, labels: DataFrame, learn_from, per_class: int = 1500, rank: int = 48, k: int = 25, max_bytes: int = 1 << 16) -> Model:
    df, n = document_frequencies(docs)
    idf = (np.log((n + 1) / (df + 1)) + 1).astype(np.float32)

    def describe(batches):
        for b in batches:
            data, offsets = C.text_bytes(b.column("text"))
            at, weight = [], []
            for i, j in C.slices(offsets):
                row, feature, w = _weights(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], idf)
                begin = np.searchsorted(row, np.arange(j - i + 1))
                at += [feature[x:z].astype(np.uint16).tobytes() for x, z in zip(begin, begin[1:])]
                weight += [w[x:z].astype(np.float32).tobytes() for x, z in zip(begin, begin[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(at, pa.binary()), pa.array(weight, pa.binary())], names=["doc_id", "y", "at", "weight"])

    got = sample(docs, labels, "quality", learn_from, per_class, max_bytes).mapInArrow(describe, "doc_id long, y int, at binary, weight binary").toArrow().sort_by("doc_id")
    y = C.ints(got["y"], np.int64)
    if not len(y):
        return Model(idf, np.zeros((DIM, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), k)
    x = np.zeros((len(y), DIM), np.float32)
    for i, (at, weight) in enumerate(zip(C.blobs(got["at"], np.uint16), C.blobs(got["weight"], np.float32))):
        x[i, at] = weight
    rank = min(rank, len(x), DIM)
    q = x @ np.random.default_rng(1).normal(size=(DIM, rank + 8)).astype(np.float32)
    for _ in range(3):  # randomized SVD by subspace iteration
        q, _ = np.linalg.qr(q)
        q = x @ (x.T @ q)
    q, _ = np.linalg.qr(q)
    space = np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T.astype(np.float32)
    model = Model(idf, space, None, y, k)
    model.near = model.project(x)
    return model


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        yield from score_batches(m.score)(batches)

    return rows.mapInArrow(run, "doc_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: quality of every document; labels of rows with crc32(doc_id) mod 5 = 0 are held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels, ~held_out(F.col("doc_id"), 5, 0))
    out = scored(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
