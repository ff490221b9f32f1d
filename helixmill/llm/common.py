"""Shared pieces of the training-data operators.

* ``materialize`` cuts lineage with a Parquet table in the cluster's shared folder.
* ``chunked`` deals documents out by a hash of the row, so no source, id or copy group is hot.
* ``shared_keys`` finds, for every chunk, those of its 64-bit keys that other rows have as well.
  Keys travel as sorted numpy blobs (about four bytes a key) instead of rows, one blob for each chunk
  and bucket: at most ``4 x shuffle partitions squared``, so chunks and buckets are kept few and long.
* ``link_components`` turns candidate lists into connected groups without all pairs of a list.
"""

from __future__ import annotations

import gc
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.session import scratch

LAST = np.iinfo(np.int64).max
U64 = np.uint64


# ------------------------------------------------------------------ session

def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunk_count(spark: SparkSession) -> int:
    """Two chunks a shuffle partition: even enough when hashed to partitions, and half of one in memory."""
    return 2 * shuffle_width(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder the cluster names."""
    return scratch(spark, name)


def materialize(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back. ``release``: let go of its large shuffle files now."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if release:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def temporary(df: DataFrame, name: str):
    """``materialize`` with release, and a function that deletes the table once nothing reads it any more."""
    out = materialize(df, name, release=True)
    spark, path = df.sparkSession, out.inputFiles()[:1]

    def delete() -> None:
        for file in path:  # a table has a folder of its own
            folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file)).getParent()
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)

    return out, delete


def named(column: str) -> Column:
    """The column of exactly this name, whatever signs it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name


def row_key(*columns: str) -> Column:
    """64-bit key of a row; rows equal in these columns share it."""
    return F.xxhash64(*[F.coalesce(named(c).cast("string"), F.lit("\0null")) for c in columns])


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(chunk, rid, doc_id, text), dealt to ``chunk_count`` chunks by row hash."""
    n = shuffle_width(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select(row_key("doc_id", "text").alias("rid"), "doc_id", "text")
    return rows.withColumn("chunk", F.pmod("rid", F.lit(chunk_count(docs.sparkSession))).cast("int")).repartition(n, "chunk")


# ------------------------------------------------------------------ bytes

_RNG = np.random.default_rng(0x5EED)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) | U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**i (or its inverse) modulo 2**64 for i < n."""
    name = "inv" if inverse else "fwd"
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, BASE_INV if inverse else BASE, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[e] - S[s] the (position-shifted) polynomial hash of data[s:e]."""
    s = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE[data] * powers(len(data)), out=s[1:])
    return s


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inv = powers(len(prefix) + 1, inverse=True)
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each span: its own bytes, padded with zeros, up to 16 of them, and a 128-bit digest of longer ones."""
    wide = np.concatenate([data, np.zeros(16, np.uint8)])
    size = end - start
    at = lambda pos: np.ndarray(len(wide) - 7, "<u8", wide, strides=(1,))[pos]
    kept = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
    low = at(start) & kept[np.minimum(size, 8)]
    high = at(np.minimum(start + 8, len(wide) - 8)) & kept[np.clip(size - 8, 0, 8)]
    for i in np.flatnonzero(size > 16).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]], digest_size=16).digest()
        low[i], high[i] = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")
    return low, high


def numbered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A dense number of each different span, and for each number one span that has it. Spans are told apart by ``word_keys`` and length."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high = word_keys(data, start, end)
    size = end - start
    mixed = mix(low ^ mix(high + size.astype(U64) * U64(0xD6E8FEB86659FD93)))

    def edges(order):
        a, b = order[1:], order[:-1]
        return (low[a] != low[b]) | (high[a] != high[b]) | (size[a] != size[b])

    order = np.argsort(mixed)
    new = edges(order)
    if ((mixed[order[1:]] == mixed[order[:-1]]) & new).any():
        order = np.lexsort((size, high, low))
        new = edges(order)
    first = np.concatenate([[True], new])
    number = np.empty(len(low), np.int64)
    number[order] = np.cumsum(first) - 1
    return number, order[first]


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word that has no algebra over its bytes, so that no texts can be made to collide for every key.

    (A polynomial over bytes modulo 2^64 takes a Thue-Morse word of 1024 signs and its complement for one.)
    """
    low, high = word_keys(data, start, end)
    return mix(low ^ mix(high + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)))


def long_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of any length: its eight-byte lanes, each mixed with its number in the span, added up.

    As ``word_hash``, without algebra over the bytes.
    """
    size = end - start
    lanes = (size + 7) // 8
    first = np.cumsum(lanes) - lanes
    total = int(lanes.sum())
    out = np.zeros(len(size), U64)
    if total:
        wide = np.concatenate([data, np.zeros(8, np.uint8)])
        number = np.arange(total) - np.repeat(first, lanes)
        left = np.repeat(size, lanes) - 8 * number
        lane = np.ndarray(len(data) + 1, "<u8", wide, strides=(1,))[np.repeat(start, lanes) + 8 * number]
        kept = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
        lane &= kept[np.minimum(left, 8)]
        some = lanes > 0
        out[some] = np.add.reduceat(mix(lane ^ mix((number + 1).astype(U64) * BASE)), first[some])
    return mix(out + size.astype(U64) * U64(0xD6E8FEB86659FD93))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and the n + 1 offsets of its rows. Null: empty."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    datas, lens = [], []
    for a in parts:
        if not len(a):
            continue
        if a.null_count:
            a = a.fill_null("")
        wide = pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
        off = np.frombuffer(a.buffers()[1], np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
        raw = a.buffers()[2]
        datas.append(np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8))
        lens.append(np.diff(off))
    data = datas[0] if len(datas) == 1 else np.concatenate(datas) if datas else np.zeros(0, np.uint8)
    offsets = np.zeros(1 + sum(map(len, lens)), np.int64)
    if lens:
        np.cumsum(np.concatenate(lens), out=offsets[1:])
    return data, offsets


def slices(offsets: np.ndarray, limit: int = 1 << 21):
    """Row ranges of at most ``limit`` bytes (one row at least), so temporaries stay small."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def ints(column, dtype=np.int64, null=LAST) -> np.ndarray:
    """An integer column as numpy; nulls become ``null``."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], a.type)
    return (a.fill_null(null) if a.null_count else a).to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def blobs(column, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) if x.is_valid else np.zeros(0, dtype) for x in column]


def words_of(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word ``[^\\x20\\x09-\\x0D]+``, or run of ``letters`` (a flag a byte); words never cross rows."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~((data == 32) | ((data >= 9) & (data <= 13))) if letters is None else letters[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of every row as (row, 64-bit hash), sorted by both.

    ``data`` is lower-cased already. A row with fewer than n words has one shingle, its whole
    sequence; a row without words has none.
    """
    start, end, row = words_of(data, offsets)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    word = word_hash(data, start, end)
    count = np.bincount(row, minlength=len(offsets) - 1)
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    at = np.arange(len(word)) - begin[row]
    left = count[row] - at
    head = (left >= n) | (at == 0)
    pos = np.flatnonzero(head)
    size = np.minimum(n, left[pos])
    padded = np.concatenate([word, np.zeros(n, U64)])
    h = np.zeros(len(pos), U64)
    for k in range(n):
        h = h * BASE + np.where(k < size, padded[pos + k], U64(0))
    h = mix(h + size.astype(U64))
    row = row[pos]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[keep], h[keep]


# ------------------------------------------------------------------ keys that more than one row has

KEYS_SCHEMA = "bucket int, chunk int, keys binary, counts binary"


def bucket_bits(spark: SparkSession) -> int:
    """As many key buckets as a power of two at or above the shuffle width."""
    return max(4, math.ceil(math.log2(shuffle_width(spark))))


def truncate(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bucket and 32 more bits of a key: what keys are compared by."""
    return keys >> U64(32 - bits)


def key_rows(chunk: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows of KEYS_SCHEMA. ``keys``: distinct truncated keys, sorted; ``counts``: uint32, the top bit marks shared."""
    bucket = (keys >> U64(32)).astype(np.int64)
    cut = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(keys))
    low = keys.astype(np.uint32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[cut], pa.int32()),
            pa.array(np.full(len(cut), chunk), pa.int32()),
            pa.array([low[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
            pa.array([counts[a:b].astype(np.uint32).tobytes() for a, b in zip(cut, ends)], pa.binary()),
        ],
        names=["bucket", "chunk", "keys", "counts"],
    )


def shared_keys(rows: DataFrame) -> DataFrame:
    """Of every chunk's keys, those that two chunks have or that are marked shared, with their total count.

    Each bucket holds an even share of the hashed keys, whatever the data; a key counts once a
    chunk, so a frequent key adds at most one entry a chunk.
    """

    def merge(table: pa.Table) -> pa.Table:
        chunk = ints(table["chunk"], np.int32)
        keys, counts = blobs(table["keys"], np.uint32), blobs(table["counts"], np.uint32)
        source = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        key, count = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key, kind="stable")
        key, count, source = key[order], count[order], source[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        total = np.add.reduceat((count & np.uint32(0x7FFFFFFF)).astype(np.int64), starts)
        marked = np.bitwise_or.reduceat(count, starts) >> np.uint32(31)
        keep = np.repeat((sizes > 1) | (marked > 0), sizes)
        total = np.repeat(np.minimum(total, 2**32 - 1), sizes).astype(np.uint32)
        key, total, source = key[keep], total[keep], source[keep]
        order = np.argsort(source, kind="stable")
        key, total, source = key[order], total[order], source[order]
        cut = np.flatnonzero(np.diff(source, prepend=-1))
        ends = np.append(cut[1:], len(key))
        return pa.table(
            {
                "bucket": pa.array(np.full(len(cut), table["bucket"][0].as_py()), pa.int32()),
                "chunk": pa.array(chunk[source[cut]], pa.int32()),
                "keys": pa.array([key[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
                "counts": pa.array([total[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
            }
        )

    return rows.groupBy("bucket").applyInArrow(merge, KEYS_SCHEMA)


def read_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The shared keys that came back to a chunk: truncated keys, sorted, and counts."""
    if not table.num_rows:
        return np.zeros(0, U64), np.zeros(0, np.uint32)
    bucket = ints(table["bucket"], np.int64)
    keys, counts = blobs(table["keys"], np.uint32), blobs(table["counts"], np.uint32)
    key = np.concatenate([(U64(b) << U64(32)) | k.astype(U64) for b, k in zip(bucket.tolist(), keys)])
    order = np.argsort(key)
    return key[order], np.concatenate(counts)[order]


def look_up(keys: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Count of each key, 0 where it isn't among ``known``."""
    if not len(known) or not len(keys):
        return np.zeros(len(keys), np.uint32)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, counts[at], np.uint32(0))


# ------------------------------------------------------------------ components

def connected_components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge (a, b); the component is its smallest node.

    ``edges``: best a written table. Each round maps a node to the least of itself and its neighbours
    (a minimum; neighbours are never collected) and contracts the edges along that map, until none is
    left. Groups around one smallest node take one round. From the third round on "least" is by a
    hash of node and round, so that long chains shrink by a constant share a round as well.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    maps = None
    for i in range(1, rounds + 1):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if i < 3:
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        else:
            order = lambda c: F.xxhash64(c, F.lit(i))  # noqa: E731, B023
            low = both.groupBy("u").agg(F.min_by("v", order("v")).alias("m")).select("u", F.when(order("m") < order("u"), F.col("m")).otherwise(F.col("u")).alias("m"))
        low = materialize(low, f"{name}-low{i}")
        maps = low.select(F.col("u").alias("node"), F.col("m").alias("component")) if maps is None else materialize(
            maps.join(low.select(F.col("u").alias("component"), "m"), "component", "left").select("node", F.coalesce("m", "component").alias("component")), f"{name}-map{i}"
        )
        ends = e.join(low.select("u", F.col("m").alias("x")), "u").join(low.select(F.col("u").alias("v"), F.col("m").alias("y")), "v")
        e = materialize(ends.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct(), f"{name}-edges{i}")
        if e.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if i < 3:
        return maps
    least = maps.groupBy("component").agg(F.min("node").alias("least"))
    return maps.join(least, "component").select("node", F.col("least").alias("component"))


def merged_components(groups: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``groups`` (node, component) joined further by ``links`` (a, b): components are worked out over the links between groups alone."""
    end = lambda e, c: e.join(groups.select(F.col("node").alias(c), F.col("component").alias(f"{c}_")), c, "left").withColumn(c, F.coalesce(f"{c}_", c)).drop(f"{c}_")
    between = materialize(end(end(links.select("a", "b"), "a"), "b").where("a <> b").distinct(), f"{name}-between")
    if between.isEmpty():
        return groups
    maps = connected_components(between, name)
    joined = groups.join(maps.select(F.col("node").alias("component"), F.col("component").alias("m")), "component", "left").select("node", F.coalesce("m", "component").alias("component"))
    alone = maps.join(groups.select("node"), "node", "left_anti")  # ends that were in no group
    return materialize(joined.unionByName(alone.select("node", "component")), f"{name}-merged")


def _with_heads(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of every entry with one first node of its keys and classes; the cached heads, to be let go of."""
    # cached or written tables stand on both sides of joins by key, so that adaptive execution may split a frequent key
    head = entries.groupBy("key", "class").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1")
    head = head.drop("n").persist()
    first = entries.join(head, ["key", "class"]).where("node <> head").groupBy("node", "head").agg(F.count("*").alias("n"))
    # the most frequent head of a node is its best bet; the rest is left to round two
    first = first.groupBy("node").agg(F.max_by("head", F.struct("n", "head")).alias("head"))
    return first.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct(), head


def link_components(entries: DataFrame, admissible, verify, name: str, links: DataFrame | None = None, likely: DataFrame | None = None) -> DataFrame:
    """Groups of nodes under verified links, without all pairs of a candidate list.

    ``entries``: (key, node, class, ...) where linked nodes share at least one key; nodes of one
    class and key are probable partners. Round one compares every entry with the first node of its
    key and class only, or tries ``likely``. Round two compares, within a key, just those entries that round one left
    in different groups, each against all entries outside its group; entries of the key's largest
    group are only ever compared with the others. So every link between different groups is found,
    and links inside a group are implied.

    ``admissible(l, r)``: a Column over two entries (aliases ``l`` and ``r``) that holds for every
    true link in at least one common key. ``verify(pairs)``: keeps true links of (a, b).
    ``links``: known links (a, b) to be counted in. ``likely``: pairs (a, b) that round one tries
    instead of those with a head. Returns (node, component).
    """
    known = links
    pairs, head = (likely, None) if likely is not None else _with_heads(entries)
    links = materialize(verify(pairs), f"{name}-links1").select("a", "b")
    if head is not None:
        head.unpersist()
    groups = connected_components(links, f"{name}-cc1")
    e = entries.join(groups, "node", "left").withColumn("g", F.coalesce("component", "node")).drop("component")
    e = materialize(e, f"{name}-grouped")
    sizes = e.groupBy("key", "g").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.max_by("g", F.struct("n", "g")).alias("top"), F.count("*").alias("groups"))
    mixed = mixed.where("groups > 1").drop("groups").persist()
    e = materialize(e.join(mixed, "key"), f"{name}-open")
    mixed.unpersist()
    few, all_ = e.where("g <> top").alias("l"), e.alias("r")
    pairs = few.join(all_, F.expr("l.key = r.key and l.g <> r.g") & admissible("l", "r"))
    pairs = pairs.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()
    more = materialize(verify(pairs), f"{name}-links2").select("a", "b")
    return merged_components(groups, more.unionByName(known) if known is not None else more, f"{name}-cc2")
