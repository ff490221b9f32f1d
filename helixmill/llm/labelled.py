"""Labelled documents to fit a classifier on: all of them, or a bounded, class-balanced sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm import common as C


def remainder(doc_id, folds: int):
    """crc32 of the id as text, modulo ``folds``: the held-out rule of the labelled rows."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def sample(
    docs: DataFrame, labels: DataFrame, label: str, learn_from, per_class: int, max_bytes: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text, y): of each class the ``per_class`` labelled ids with the smallest hash.

    ``learn_from``: Column over ``labels`` that admits a row. At most ``2 * per_class`` ids, a fixed
    bound, are joined with the documents; each gives one text (that of the smallest row hash). Texts
    of more than ``max_bytes`` aren't learned from, so the sample has ``2 * per_class * max_bytes``
    bytes at most. A label given twice counts as 1 if either is. Nothing of it is collected here.
    """
    rows = labels.where(learn_from).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = rows.where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = rows.withColumn("o", F.xxhash64("doc_id"))
    some = rows.where("y = 0").orderBy("o", "doc_id").limit(per_class).unionByName(rows.where("y = 1").orderBy("o", "doc_id").limit(per_class))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chosen = texts.where(F.octet_length("text") <= max_bytes).join(F.broadcast(some.drop("o")), "doc_id")
    return chosen.groupBy("doc_id", "y").agg(F.min_by("text", C.row_key("doc_id", "text")).alias("text")).select("doc_id", "text", "y")


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn_from, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, y) of every labelled id that ``learn_from`` admits, by the rules of ``sample`` but without bounds."""
    rows = labels.where(learn_from).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = rows.where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chosen = texts.join(rows, "doc_id")
    return chosen.groupBy("doc_id", "y").agg(F.min_by("text", C.row_key("doc_id", "text")).alias("text")).select("doc_id", "text", "y")


def held_out(doc_id, folds: int, fold: int):
    """Whether the id's remainder is ``fold``; an id that is null is in no fold."""
    return F.coalesce(remainder(doc_id, folds) == fold, F.lit(False))


def score_batches(score, id_col="doc_id"):
    """mapInArrow function: (doc_id, score) of (doc_id, text) batches, a few MB of text at a time."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            data, offsets = C.text_bytes(b.column("text"))
            out = [score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in C.slices(offsets)]
            values = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values.astype(np.float64))], names=["doc_id", "score"])

    return run
