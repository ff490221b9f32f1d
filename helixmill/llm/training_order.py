"""Operator 4, training-order materialisation: a keyed Feistel permutation gives each sequence its slot.

1. Every partition lays its documents' ids end to end (each document ends with ``end_id``) and cuts
   them into sequences of ``size`` ids; only its last sequence is padded.
2. Partition counts give each sequence a dense number i in [0, N); its slot is the Feistel
   permutation of i over the next even power of two, walked until it falls below N.
3. Shard s holds the slots [s * per_shard, (s + 1) * per_shard). Sequences are dealt out by ranges of
   slots, a partition a shard, and one task writes one shard: records
   of a fixed stride (``size`` ids of 16 or 32 bits), so slot t stands at byte
   ``(t mod per_shard) * stride`` and a reader resumes anywhere. A shard is written beside its
   place and then moved, so a repeated task leaves the same file.

The order is fixed by the key, the table and its files' partitioning; ``sequences`` is written once,
so a repeated task never changes it.

Rows: a null or empty text is the end id alone; repeated rows are written again; a null doc_id
counts as any other; other columns are ignored; no rows give no shards. An id that ``id_bytes`` can't hold is
an error, never another id.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm import common as C
from helixmill.llm.tokens import encode_rows, tokenizer_path

U64 = np.uint64
SEQUENCES = "part int, place long, n_tokens int, first_doc_id long, last_doc_id long, ids binary"
SHARDS = "slot long, shard int, byte_offset long, n_tokens int, first_doc_id long, last_doc_id long, ids_crc32 long, path string"


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A permutation of [0, n) chosen by ``key``, at ``index``; cycle-walking keeps it inside."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    low = U64((1 << half) - 1)
    keys = C.mix(np.arange(1, rounds + 1, dtype=U64) * C.BASE + U64(key % 2**64))

    def once(x):
        left, right = x >> U64(half), x & low
        for k in keys:
            left, right = right, left ^ (C.mix(right + k) & low)
        return (left << U64(half)) | right

    x = once(index.astype(U64))
    out = x >= U64(n)
    while out.any():
        x[out] = once(x[out])
        out = x >= U64(n)
    return x.astype(np.int64)


def sequences(docs: DataFrame, size: int = 2048, tokenizer: str | None = None, end_id: int = 1, pad_id: int = 0, id_bytes: int = 2, id_col="doc_id", text_col="text") -> DataFrame:
    """Fixed-length sequences by partition: SEQUENCES, ``ids`` padded to ``size``."""
    path, kind = tokenizer_path(tokenizer), {2: np.uint16, 4: np.uint32}[id_bytes]

    def cut(batches):
        part, place = TaskContext.get().partitionId(), 0
        if pad_id > np.iinfo(kind).max:
            raise ValueError(f"id {pad_id} doesn't fit in {id_bytes} bytes")
        rest, owner = np.zeros(0, kind), np.zeros(0, np.int64)
        names = [f.split()[0] for f in SEQUENCES.split(", ")]
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        named = lambda d: None if d == C.LAST else int(d)

        def batch(done):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)

        for b in batches:
            ids, texts = C.ints(b.column("doc_id")), b.column("text")
            for lo in range(0, len(ids), 2000):
                wide, count = encode_rows(texts.slice(lo, 2000), path, end_id)
                owner = np.concatenate([owner, np.repeat(ids[lo : lo + 2000], count)])
                if len(wide) and wide.max() > np.iinfo(kind).max:
                    raise ValueError(f"id {wide.max()} doesn't fit in {id_bytes} bytes")
                rest = np.concatenate([rest, wide.astype(kind)])
                done = []
                for k in range(0, len(rest) - size + 1, size):
                    done.append((part, place, size, named(owner[k]), named(owner[k + size - 1]), rest[k : k + size].tobytes()))
                    place += 1
                if done:
                    yield batch(done)
                    rest, owner = rest[len(done) * size :], owner[len(done) * size :]
        if len(rest):
            padded = np.full(size, pad_id, kind)
            padded[: len(rest)] = rest
            yield batch([(part, place, len(rest), named(owner[0]), named(owner[-1]), padded.tobytes())])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(cut, SEQUENCES)


def in_training_order(seqs: DataFrame, key: int = 20240229) -> DataFrame:
    """Adds ``slot``: every sequence's place in the order that ``key`` chooses."""
    counts = seqs.groupBy("part").agg((F.max("place") + 1).alias("n"))
    # one row a partition of the input, never one a sequence
    rows = sorted((r["part"], r["n"]) for r in counts.collect())
    base, total = {}, 0
    for part, n in rows:
        base[part], total = total, total + n
    known = np.array([(p, b) for p, b in base.items()], np.int64).reshape(-1, 2)

    @F.pandas_udf("long")
    def slot_of(part: pd.Series, place: pd.Series) -> pd.Series:
        start = known[np.searchsorted(known[:, 0], part.to_numpy()), 1]
        return pd.Series(feistel(start + place.to_numpy(), total, key))

    return seqs.withColumn("slot", slot_of("part", "place"))


def write_shards(ordered: DataFrame, folder: str, size: int = 2048, per_shard: int = 2048, id_bytes: int = 2) -> DataFrame:
    """Write ``folder``/shard-NNNNNN.bin and return a row per sequence (SHARDS)."""
    stride = size * id_bytes
    last = ordered.agg(F.max("slot")).first()[0]
    if last is None:
        return ordered.sparkSession.createDataFrame([], SHARDS)

    def write(batches):
        fs = beside = None
        rows: list[pa.RecordBatch] = []
        for b in batches:  # the partition's slots are one shard's, ascending
            if not b.num_rows:
                continue
            slot, ids = C.ints(b["slot"]), b["ids"]
            if fs is None:
                fs, root = pafs.FileSystem.from_uri(folder)
                fs.create_dir(root, recursive=True)
                shard = int(slot[0]) // per_shard
                path, beside = f"{root}/shard-{shard:06d}.bin", f"{root}/_writing-{uuid.uuid4().hex}"
                out = fs.open_output_stream(beside)
            for x in ids:
                out.write(x.as_buffer())
            crc = [zlib.crc32(memoryview(x.as_buffer())[: n * id_bytes]) for x, n in zip(ids, b["n_tokens"].to_pylist())]
            columns = [slot, np.full(len(slot), shard, np.int32), slot % per_shard * stride, b["n_tokens"], b["first_doc_id"], b["last_doc_id"], np.array(crc, np.int64)]
            rows.append(pa.RecordBatch.from_arrays([*[c if isinstance(c, pa.Array) else pa.array(c) for c in columns], pa.array([path] * len(slot))], names=[c.split()[0] for c in SHARDS.split(", ")]))
        if fs is not None:
            out.close()
            fs.move(beside, path)
        yield from rows

    # one partition a range of slots, which is a shard
    ranged = ordered.repartitionById(last // per_shard + 1, F.expr(f"cast(slot div {per_shard} as int)")).sortWithinPartitions("slot")
    return ranged.mapInArrow(write, SHARDS)


def read_shards(folder: str, first: int, last: int, size: int = 2048, per_shard: int = 2048, id_bytes: int = 2):
    """Sequences of the slots [first, last), in order, by seeking: how a training job resumes."""
    fs, root = pafs.FileSystem.from_uri(folder)
    kind, stride = {2: np.uint16, 4: np.uint32}[id_bytes], size * id_bytes
    for shard in range(first // per_shard, -(-last // per_shard)):
        with fs.open_input_file(f"{root}/shard-{shard:06d}.bin") as f:
            a, z = max(first, shard * per_shard), min(last, (shard + 1) * per_shard)
            f.seek((a - shard * per_shard) * stride)
            for _ in range(a, z):
                raw = f.read(stride)
                if len(raw) < stride:
                    return
                yield np.frombuffer(raw, kind)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: all documents as 2048-id sequences in a keyed training order, written as binary shards, whose paths are returned."""
    seqs = C.materialize(sequences(spark.read.parquet(f"{sf_dir}/documents.parquet")), "sequences")
    shards = write_shards(in_training_order(seqs), C.scratch_path(spark, "shards"))
    # the files are written once; what the query returns is the list of them
    return C.materialize(shards, "shard-list", release=True).select("slot", "shard", "byte_offset", "n_tokens", "first_doc_id", "last_doc_id", "ids_crc32", "path")
