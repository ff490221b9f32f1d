"""Operator 10, n-gram Jaccard join: rare-first prefix filtering, verified once per pair.

1. Every chunk turns its texts into sets of distinct 5-word shingles (64-bit hashes) and collapses
   rows with equal sets. ``shared_keys`` counts each shingle over all documents.
2. A set is ordered rarest shingle first. Two sets that reach the threshold have a shingle in
   common within their prefixes of ``size - ceil(t * size) + 1``; shingles that one set alone has
   join nothing and stay behind, but keep their places in the order.
3. Sets are joined on prefix shingles under a length and a positional filter
   (``common.link_components``: no list of a frequent shingle is turned into all its pairs).
4. Each pair is verified once: first a suffix filter, which bounds the overlap by how many hashes
   of either set fall into each of 16 ranges, then the exact overlap.

Rows: lower-cases A-Z only; words are ``[^\\x20\\x09-\\x0D]+``. A text of fewer than five words has
its whole sequence as one shingle; an empty or null text has none and links with nothing. Rows with
the same doc_id are one document: a link of one of them links all. A row with a null doc_id links
with nothing and has a null component_id. Other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm import common as C

U64 = np.uint64
SETS = "doc_id long, n_shingles long, rep long, shingles binary, keys array<long>, places array<int>"


def _sets(table: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = C.text_bytes(table["text"])
    rows, hashes = [], []
    for i, j in C.slices(offsets):
        part = C.lower_ascii(data[offsets[i] : offsets[j]])
        r, h = C.shingle_sets(part, offsets[i : j + 1] - offsets[i], n)
        rows.append(r + i)
        hashes.append(h)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    return np.concatenate(rows), np.concatenate(hashes)


def _equal_sets(row: np.ndarray, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row its size, and the row that stands for its set: that of the smallest document with it.

    A row without shingles stands for itself alone.
    """
    n = len(doc)
    size = np.bincount(row, minlength=n).astype(np.int64)
    total, other = np.zeros(n, U64), np.zeros(n, U64)
    at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    if len(at):
        total[row[at]] = np.add.reduceat(C.mix(h), at)
        other[row[at]] = np.bitwise_xor.reduceat(C.mix(h + U64(1)), at)
    order = np.lexsort((doc, other, total, size))
    head = np.ones(n, bool)
    head[1:] = (np.diff(size[order]) != 0) | (total[order][1:] != total[order][:-1]) | (other[order][1:] != other[order][:-1])
    head |= size[order] == 0
    rep = np.empty(n, np.int64)
    rep[order] = order[np.flatnonzero(head)][np.cumsum(head) - 1] if n else order
    return size, rep


def _by_rid(table: pa.Table) -> pa.Table:
    return table.take(pa.array(np.argsort(C.ints(table["rid"]), kind="stable")))


def shingle_table(docs: DataFrame, percent: int = 75, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: size of its set, its representative in the chunk, and for representatives
    that may link, the set and the prefix shingles (with their places) that other sets have too."""
    bits = C.bucket_bits(docs.sparkSession)
    x = C.chunked(docs, id_col, text_col)

    def announce(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        table = _by_rid(table)
        row, h = _sets(table, n)
        _, rep = _equal_sets(row, h, C.ints(table["doc_id"]))
        key = np.sort(C.truncate(h[rep[row] == row], bits))
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        counts = np.diff(np.append(at, len(key))).astype(np.uint32)
        counts |= (counts > 1).astype(np.uint32) << np.uint32(31)
        return pa.Table.from_batches([C.key_rows(chunk, key[at], counts, bits)])

    def prefixes(group, table: pa.Table, known: pa.Table) -> pa.Table:
        table = _by_rid(table)
        doc = C.ints(table["doc_id"])
        row, h = _sets(table, n)
        size, rep = _equal_sets(row, h, doc)
        mine = (rep[row] == row) & (doc[row] != C.LAST)
        row, h = row[mine], h[mine]
        key = C.truncate(h, bits)
        count = C.look_up(key, *C.read_keys(known))
        order = np.lexsort((h, key, np.maximum(count, 1), row))
        place = np.arange(len(row)) - np.searchsorted(row, row)
        need = (percent * size + 99) // 100
        r = row[order]
        use = (place < (size - need + 1)[r]) & (count[order] > 1)
        active = np.zeros(len(doc), bool)
        active[r[use]] = True
        begin = np.searchsorted(row, np.arange(len(doc) + 1))
        bounds = np.concatenate([[0], np.cumsum(np.bincount(r[use], minlength=len(doc)))]).astype(np.int32)
        keys = pa.ListArray.from_arrays(pa.array(bounds), pa.array(key[order][use].astype(np.int64)))
        places = pa.ListArray.from_arrays(pa.array(bounds), pa.array(place[use].astype(np.int32)))
        sets = [h[begin[i] : begin[i + 1]].tobytes() if active[i] else None for i in range(len(doc))]
        stands = pa.array(doc[rep], mask=doc[rep] == C.LAST)
        return pa.table({"doc_id": table["doc_id"], "n_shingles": pa.array(size), "rep": stands, "shingles": pa.array(sets, pa.binary()), "keys": keys, "places": places})

    shared = C.shared_keys(x.groupBy("chunk").applyInArrow(announce, C.KEYS_SCHEMA))
    return x.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(prefixes, SETS)


def _verify(sets: DataFrame, percent: int):
    def check(batches):
        edges = (np.arange(1, 16, dtype=np.uint64) << U64(60)).astype(U64)
        for b in batches:
            keep = []
            for x, y in zip(C.blobs(b.column("x"), U64), C.blobs(b.column("y"), U64)):
                both, ok = len(x) + len(y), False
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    px = np.diff(np.searchsorted(x, edges), prepend=0, append=len(x))
                    py = np.diff(np.searchsorted(y, edges), prepend=0, append=len(y))
                    if (100 + percent) * int(np.minimum(px, py).sum()) >= percent * both:
                        common = len(np.intersect1d(x, y, assume_unique=True))
                        ok = (100 + percent) * common >= percent * both
                keep.append(ok)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verify(pairs: DataFrame) -> DataFrame:
        x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct()

    return verify


def similar_groups(docs: DataFrame, percent: int = 75, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; the component is its smallest doc_id."""
    table = C.materialize(shingle_table(docs, percent, n, id_col, text_col), "shingles", release=True)
    active = table.where("shingles is not null")
    sets = active.select(F.col("rep").alias("node"), "shingles")
    entries = active.select(F.col("rep").alias("node"), F.col("n_shingles").alias("size"), F.explode(F.arrays_zip("keys", "places")).alias("e"))
    step = F.lit(float(np.log(100 / percent)) or 1.0)
    entries = entries.select(
        F.col("e.keys").alias("key"), "node", "size", F.col("e.places").alias("place"), F.floor(F.log("size") / step).cast("int").alias("class")
    )
    entries = C.materialize(entries, "entries")

    def admissible(l: str, r: str):
        lengths = F.expr(f"100 * least({l}.size, {r}.size) >= {percent} * greatest({l}.size, {r}.size)")
        places = F.expr(f"{100 + percent} * least({l}.size - {l}.place, {r}.size - {r}.place) >= {percent} * ({l}.size + {r}.size)")
        return lengths & places

    # rows that stand behind an equal set of their chunk
    within = table.where("rep is not null and doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    groups = C.link_components(entries, admissible, _verify(sets, percent), "jaccard", within)
    return table.join(groups, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op10: near-duplicate groups of documents at Jaccard 0.75 over 5-word shingles."""
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sets as (
  select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end) as s from words),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 175 * c >= 75 * (p.n + q.n)),
reach as (select doc_id as node, doc_id as other from documents union select r.node, l.y from reach r join links l on l.x = r.other)
select d.doc_id, coalesce(s.n, 0) as n_shingles, r.component_id
from documents d left join sizes s using (doc_id)
join (select node as doc_id, min(other) as component_id from reach group by node) r using (doc_id)
"""
