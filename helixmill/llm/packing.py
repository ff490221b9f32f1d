"""Operator 9, packing: bounded-space online best fit.

Each partition keeps at most ``open_windows`` open windows of ``size`` ids. A document gives whole
windows as long as it lasts; its rest goes to the fullest open window that still holds it. If none
does and no window is free, the fullest is emitted and a new one opened. The windows that are still
open at the end of a partition (a bounded number of pieces) are leftovers: they are dealt into
groups of partitions, laid end to end and cut afresh, so that all windows of a group are full but
the last; that one is cut into lengths that are powers of two, which take no padding.

Rows: a null or empty text is the end id alone; a null doc_id is kept; repeated rows are packed
again; other columns are ignored; no rows give no pieces. The ids of a piece come along (``ids``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm import common as C
from helixmill.llm.tokens import encode_rows, tokenizer_path

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, leftover int, slot long"
_NAMES = [f.split()[0] for f in PIECES.split(", ")]


class _Rows:
    """Pieces as columns, handed on in batches."""

    def __init__(self):
        self.columns = {n: [] for n in _NAMES}

    def add(self, doc, start, ids, total, sequence, offset, leftover=0, slot=0):
        c = self.columns
        for n, v in zip(_NAMES, (doc, start, len(ids) // 4, total, sequence, offset, ids, leftover, slot)):
            c[n].append(v)

    def full(self):
        return len(self.columns["ids"]) >= 2000

    def take(self) -> pa.RecordBatch:
        kinds = {"ids": pa.binary(), "leftover": pa.int32()}
        batch = pa.RecordBatch.from_arrays([pa.array(v, kinds.get(n, pa.int64())) for n, v in self.columns.items()], names=_NAMES)
        self.__init__()
        return batch


def _powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(
    docs: DataFrame, size: int = 2048, open_windows: int = 64, merge: int = 16, tokenizer: str | None = None, end_id: int = 1,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids) of every piece."""
    path = tokenizer_path(tokenizer)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def place(batches):
        part = TaskContext.get().partitionId()
        base, made, out = part << 34, 0, _Rows()
        windows: list[list] = []  # [used, pieces]

        def emit(pieces):
            nonlocal made
            at = 0
            for doc, start, ids, total in pieces:
                out.add(doc, start, ids, total, base + made, at)
                at += len(ids) // 4
            made += 1

        for b in batches:
            doc_ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            for lo in range(0, len(doc_ids), 2000):
                coded, count = encode_rows(texts.slice(lo, 2000), path, end_id)
                raw = coded.tobytes()
                ends = (np.cumsum(count) * 4).tolist()
                for doc, ids in zip(doc_ids[lo : lo + 2000], (raw[z - 4 * n : z] for z, n in zip(ends, count.tolist()))):
                    total = len(ids) // 4
                    whole = total // size * size
                    for s in range(0, whole, size):
                        emit([(doc, s, ids[4 * s : 4 * (s + size)], total)])
                    rest = total - whole
                    if rest:
                        piece = (doc, whole, ids[4 * whole :], total)
                        best = max((w for w in windows if w[0] + rest <= size), key=lambda w: w[0], default=None)
                        if best is None and len(windows) >= open_windows:
                            fullest = max(windows, key=lambda w: w[0])
                            windows.remove(fullest)
                            emit(fullest[1])
                        if best is None:
                            windows.append(best := [0, []])
                        best[0] += rest
                        best[1].append(piece)
                        if best[0] == size:
                            windows.remove(best)
                            emit(best[1])
                    if out.full():
                        yield out.take()
        slot = 0
        for _, pieces in windows:
            for doc, start, ids, total in pieces:
                out.add(doc, start, ids, total, part, 0, 1, slot)
                slot += 1
        yield out.take()

    def close(batches):
        part = TaskContext.get().partitionId()
        base, made, used, out = (1 << 62) | (part << 34), 0, 0, _Rows()
        last: list = []  # pieces of the window being filled
        for b in batches:
            for r in b.select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist():
                ids, start = r["ids"], r["start"]
                while ids:
                    room = (size - used) * 4
                    cut, ids = ids[:room], ids[room:]
                    last.append((r["doc_id"], start, cut, r["doc_tokens"], used))
                    start += len(cut) // 4
                    used += len(cut) // 4
                    if used == size:
                        for d, s, x, t, o in last:
                            out.add(d, s, x, t, base + made, o)
                        made, used, last = made + 1, 0, []
                if out.full():
                    yield out.take()
        begin = 0
        for n in _powers(used):
            for d, s, x, t, o in last:
                a, z = max(o, begin), min(o + len(x) // 4, begin + n)
                if a < z:
                    out.add(d, s + a - o, x[4 * (a - o) : 4 * (z - o)], t, base + made, a - begin)
            begin, made = begin + n, made + 1
        yield out.take()

    placed = C.materialize(source.mapInArrow(place, PIECES), "placed")
    # leftovers of `merge` partitions meet in one task: at most merge * open_windows windows
    left = placed.where("leftover = 1").withColumn("g", F.floor(F.col("sequence_id") / merge))
    n = max(1, -(-C.shuffle_width(docs.sparkSession) // merge))
    left = left.repartition(n, "g").sortWithinPartitions("sequence_id", "slot").drop("g")
    done = placed.where("leftover = 0").unionByName(left.mapInArrow(close, PIECES))
    return done.drop("leftover", "slot")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: all documents in sequences of at most 2048 tokens; ids as a CRC-32 of each piece."""
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
