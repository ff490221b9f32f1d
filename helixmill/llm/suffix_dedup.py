"""Operator 2, suffix-array dedup: threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every 50-byte window belongs to the run of windows around it that have the same minimizer (the
smallest hash of a 24-byte string inside). Equal windows have equal minimizers, so dealing runs
out by minimizer brings all equal windows together, wherever they stand.

1. ``shared_keys`` leaves only minimizers that two documents have; all other runs can't match.
2. Each chunk sends its distinct runs (contents with their smallest document, never occurrences) to
   the part of their minimizer. A minimizer with more than ``hot`` distinct runs is split: its
   windows go out one by one, by their own content. No part ever holds an unbounded group.
3. A part sorts its suffixes to the threshold's depth, and from the Burrows-Wheeler transform
   extends intervals backwards, breadth first: level l finds just those common prefixes that are
   l bytes long, from those of level l - 1. It stops at the threshold; suffixes not parted by then
   share 50 bytes. Per group of such suffixes, the smallest document counts.
4. Chunks get an answer for each content, look it up for their own occurrences and cut the bytes.

Rows: a null text is empty; a null doc_id is larger than any other; rows with the same doc_id
don't match each other; identical rows get identical results; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm import common as C

U64 = np.uint64
MINIMIZER = 24
#: bytes that a part transforms at a time; classes of minimizers by which it divides its runs
SHARE, CLASSES = 1 << 19, 256
#: bytes of a chunk whose windows are hashed at a time
SLICE = 1 << 19
#: hot: the minimizers of split windows; several: whether documents of the chunk differ
SEGMENTS = "part int, chunk int, lens binary, classes binary, docs binary, several binary, data binary, hot binary"
ANSWERS = "chunk int, contents binary, offsets binary, lens binary, docs binary, hot binary"


def _minimizers(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, key, row) of every run of windows with one minimizer; no window crosses rows."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    n, m = len(data), min(MINIMIZER, window)
    if n < window:
        return none
    h, k = C.BYTE[data], 1
    done, width = None, 0  # hash of the last m bytes' higher powers, by doubling
    power = C.BASE
    while True:
        if m & k:
            done, width = (h, k) if done is None else (done[: n - width - k + 1] * power + h[width : width + n - width - k + 1], width + k)
        if 2 * k > m:
            break
        h = h[:-k] * power + h[k:]
        power = U64(int(power) ** 2 % 2**64)
        k *= 2
    h = C.mix(done)
    span, k, low = window - m + 1, 1, h
    while 2 * k <= span:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    low = np.minimum(low[: len(h) - span + 1], low[span - k : len(h) - k + 1])
    cover = np.zeros(n + 1, np.int32)
    ends = offsets[1:]
    np.add.at(cover, np.maximum(offsets[:-1], ends - window + 1), 1)
    np.add.at(cover, ends, -1)
    valid = np.cumsum(cover)[: len(low)] == 0
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
    start = np.flatnonzero(first)
    if not len(start):
        return none
    stop = np.append(start[1:], len(low))
    left = np.concatenate([[0], np.cumsum(valid)])
    # minima are small numbers; mixed, they spread over all buckets
    return start, left[stop] - left[start], C.mix(low[start]), np.searchsorted(offsets, start, side="right") - 1


def _by_rid(table: pa.Table) -> pa.Table:
    return table.take(pa.array(np.argsort(C.ints(table["rid"]), kind="stable")))


def _runs(data, offsets, window):
    """All runs of a chunk, with their contents' hash; starts count from the chunk's first byte."""
    got = []
    for i, j in C.slices(offsets, SLICE):
        lo = offsets[i]
        part = data[lo : offsets[j]]
        s, w, k, r = _minimizers(part, offsets[i : j + 1] - lo, window)
        if len(s):
            got.append((s + lo, w, k, r + i, C.span_hash(C.prefix_hash(part), s, s + w + window - 1)))
    if not got:
        return [np.zeros(0, t) for t in (np.int64, np.int64, U64, np.int64, U64)]
    return [np.concatenate(x) for x in zip(*got)]


def _blob(a: np.ndarray, dtype) -> bytes:
    return np.ascontiguousarray(a, dtype).tobytes()


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., start[1], ...: the positions that the spans cover."""
    total = int(length.sum())
    shift = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
    return shift + np.arange(total)


def _lcp_groups(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array (sorted to ``depth`` symbols at least) and, over it, where a common prefix is shorter than ``depth``.

    ``symbols`` are below 512. The boundary bits start as those of one symbol. Level l + 1 comes by
    backward extension: two neighbours c.x and c.y in suffix order are parted exactly if x and y,
    their places under the last-to-first mapping of the transform, were parted at level l.
    """
    n = len(symbols)
    s = np.concatenate([symbols.astype(np.int64), np.zeros(8, np.int64)])
    p2 = (s[:-1] << 9) | s[1:]
    p4 = (p2[:-2] << 18) | p2[2:]
    key = (p4[: n] << 27) | (p2[4 : 4 + n] << 9) | s[6 : 6 + n]
    k = 7
    while True:
        sa = np.argsort(key)  # ties may stand in any order
        sorted_key = key[sa]
        step = np.concatenate([[0], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)])
        if k >= depth or step.sum() == n - 1:
            break
        rank = np.empty(n, np.int64)
        rank[sa] = np.cumsum(step) + 1
        shifted = np.zeros(n, np.int64)
        shifted[:-k or None] = rank[k:] if k < n else 0
        key = rank * (n + 2) + shifted
        k *= 2
    inverse = np.empty(n + 1, np.int32)
    inverse[sa] = np.arange(n, dtype=np.int32)
    inverse[n] = n  # the empty suffix
    mapped = inverse[sa + 1]
    first = symbols[sa]
    parted = np.ones(n + 1, bool)
    parted[1:n] = first[1:] != first[:-1]
    open_ = np.flatnonzero(~parted)
    for _ in range(1, depth):
        if not len(open_):
            break
        group = np.cumsum(parted, dtype=np.int32)
        new = group[mapped[open_ - 1]] != group[mapped[open_]]
        if not new.any():
            break
        parted[open_[new]] = True
        open_ = open_[~new]
    return sa, parted[:n]


def _smallest(text: np.ndarray, length: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(run, content, smallest document, offset, windows) of the stretches of windows that have one smallest document.

    ``text``: all runs end to end. Copies have their runs in common: each content stands in the
    transform once, for its smallest document.
    """
    limit = np.cumsum(length)
    hashed = C.span_hash(C.prefix_hash(text), limit - length, limit)
    _, one, same = np.unique(hashed, return_index=True, return_inverse=True)
    least = np.full(len(one), C.LAST)
    np.minimum.at(least, same, doc)
    text = text[_ranges((limit - length)[one], length[one])]
    length = length[one]
    # one separator (0) after each run; bytes become 1 to 256
    end = np.cumsum(length + 1)
    begin = end - length - 1
    symbols = np.zeros(int(end[-1]), np.int16)
    symbols[_ranges(begin, length)] = text.astype(np.int16) + 1
    sa, parted = _lcp_groups(symbols, window)
    owner = np.repeat(np.arange(len(length)), length + 1)
    whole = (end - 1)[owner] - np.arange(len(symbols)) >= window
    value = np.where(whole, least[owner], C.LAST)[sa]
    at = np.flatnonzero(parted)
    best = np.empty(len(symbols), np.int64)
    best[sa] = np.repeat(np.minimum.reduceat(value, at), np.diff(np.append(at, len(sa))))
    pos = np.flatnonzero(whole)
    own, b = owner[pos], best[pos]
    head = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (b[1:] != b[:-1])])) if len(pos) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(pos)))
    own, b, off = own[head], b[head], pos[head] - begin[own[head]]
    # back to the runs as they came
    sent = np.argsort(same, kind="stable")
    copies = np.bincount(same, minlength=len(one))
    first = np.concatenate([[0], np.cumsum(copies)[:-1]])
    src = np.repeat(np.arange(len(own)), copies[own])
    return sent[_ranges(first[own], copies[own])], hashed[one][own][src], b[src], off[src], size[src]


def _windows_of(data, offsets, start, wins, row, window):
    """(start, row, hash) of every window of the runs, one by one."""
    at, owner = _ranges(start, wins), np.repeat(row, wins)
    h = np.empty(len(at), U64)
    for i, j in C.slices(offsets, SLICE):
        lo, hi = np.searchsorted(at, (offsets[i], offsets[j]))
        if hi > lo:
            here = at[lo:hi] - offsets[i]
            h[lo:hi] = C.span_hash(C.prefix_hash(data[offsets[i] : offsets[j]]), here, here + window)
    return at, owner, h


def repeated_spans(docs: DataFrame, min_bytes: int = 50, hot: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(chunk, rid, doc_id, text, spans): spans are the maximal (start, end) byte runs to remove."""
    spark = docs.sparkSession
    bits, window = C.bucket_bits(spark), min_bytes
    parts = 2 * C.shuffle_width(spark)
    x = C.chunked(docs, id_col, text_col)

    def announce(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        table = _by_rid(table)
        data, offsets = C.text_bytes(table["text"])
        doc = C.ints(table["doc_id"])
        _, _, key, row, content = _runs(data, offsets, window)
        key = C.truncate(key, bits)
        order = np.lexsort((content, key))
        key, content, doc = key[order], content[order], doc[row[order]]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        if not len(key):
            return pa.Table.from_batches([C.key_rows(chunk, key, np.zeros(0, np.uint32), bits)])
        fresh = np.ones(len(key), np.int64)
        fresh[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
        several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
        counts = np.add.reduceat(fresh, starts).astype(np.uint32) | (several.astype(np.uint32) << np.uint32(31))
        return pa.Table.from_batches([C.key_rows(chunk, key[starts], counts, bits)])

    def segments(group, table: pa.Table, known: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in SEGMENTS.split(", ")]
        empty = pa.table({n: pa.array([], pa.int32() if n in ("part", "chunk") else pa.binary()) for n in names})
        if not table.num_rows or not known.num_rows:
            return empty
        chunk = table["chunk"][0].as_py()
        table = _by_rid(table)
        data, offsets = C.text_bytes(table["text"])
        doc = C.ints(table["doc_id"])
        start, wins, key, row, content = _runs(data, offsets, window)
        count = C.look_up(C.truncate(key, bits), *C.read_keys(known))
        keep = count > 0
        start, wins, key, row, content, count = (a[keep] for a in (start, wins, key, row, content, count))
        split = count > hot
        if split.any():  # windows of crowded minimizers go out one by one
            at, owner, h = _windows_of(data, offsets, start[split], wins[split], row[split], window)
            start, row = np.concatenate([start[~split], at]), np.concatenate([row[~split], owner])
            minimizer = np.concatenate([np.zeros(int((~split).sum()), U64), np.repeat(C.truncate(key[split], bits) + U64(1), wins[split])])
            wins = np.concatenate([wins[~split], np.ones(len(at), np.int64)])
            key, content = np.concatenate([key[~split], C.mix(h)]), np.concatenate([content[~split], h])
        else:
            minimizer = np.zeros(len(key), U64)
        if not len(start):
            return empty
        order = np.lexsort((content, key))
        start, wins, key, row, content, minimizer = (a[order] for a in (start, wins, key, row, content, minimizer))
        fresh = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (content[1:] != content[:-1])]))
        smallest, largest = np.minimum.reduceat(doc[row], fresh), np.maximum.reduceat(doc[row], fresh)
        # parts by the key's low bits; the bucket took the high ones
        part_of = (key[fresh] % U64(parts)).astype(np.int64)
        by_part = np.argsort(part_of, kind="stable")
        cut = np.flatnonzero(np.diff(part_of[by_part], prepend=-1))
        out = {n: [] for n in names}
        for members in np.split(by_part, cut[1:]):
            lens = wins[fresh[members]] + window - 1
            crowded = np.unique(minimizer[fresh[members]])
            out["part"].append(int(part_of[members[0]]))
            out["chunk"].append(chunk)
            out["lens"].append(_blob(lens, np.uint32))
            out["classes"].append(_blob(key[fresh[members]] // U64(parts) % U64(CLASSES), np.uint8))
            out["docs"].append(_blob(smallest[members], np.int64))
            out["several"].append(_blob(smallest[members] < largest[members], np.uint8))
            out["data"].append(data[_ranges(start[fresh[members]], lens)].tobytes())
            out["hot"].append(_blob(crowded[crowded > 0], U64))
        return pa.table({n: pa.array(v, pa.int32() if n in ("part", "chunk") else pa.binary()) for n, v in out.items()})

    def expand(table: pa.Table) -> pa.Table:
        chunk = C.ints(table["chunk"], np.int32)
        lens = C.blobs(table["lens"], np.uint32)
        per_row = [len(x) for x in lens]
        length = np.concatenate(lens).astype(np.int64)
        doc = np.concatenate(C.blobs(table["docs"], np.int64))
        several = np.concatenate(C.blobs(table["several"], np.uint8)) > 0
        text = np.concatenate(C.blobs(table["data"], np.uint8))
        limit = np.cumsum(length)
        kind = np.concatenate(C.blobs(table["classes"], np.uint8)).astype(np.int64)
        # runs of one minimizer are of one class; a few classes at a time keep the transform small
        shares = min(CLASSES, -(-len(text) // SHARE))
        share = kind * shares // CLASSES
        by_share = np.argsort(share, kind="stable")
        pieces = []
        for members in np.split(by_share, np.flatnonzero(np.diff(share[by_share])) + 1):
            size = length[members]
            own, content, b, off, wins = _smallest(text[_ranges(limit[members] - size, size)], size, doc[members], window)
            # of use where some document of the chunk with this content is larger than the smallest
            useful = (b < doc[members[own]]) | several[members[own]]
            pieces.append((members[own[useful]], content[useful], b[useful], off[useful], wins[useful]))
        own, content, b, off, size = (np.concatenate(x) for x in zip(*pieces))
        to = np.repeat(np.arange(len(per_row)), per_row)[own]  # the message, of which each chunk sent one
        order = np.argsort(to, kind="stable")
        to, content, b, off, size = to[order], content[order], b[order], off[order], size[order]
        cut = np.flatnonzero(np.diff(to, prepend=-1))
        ends = np.append(cut[1:], len(to))
        columns = {"contents": (content, U64), "offsets": (off, np.uint32), "lens": (size + window - 1, np.uint32), "docs": (b, np.int64)}
        out = {"chunk": pa.array(chunk[to[cut]], pa.int32())}
        out |= {n: pa.array([_blob(v[a:z], t) for a, z in zip(cut, ends)], pa.binary()) for n, (v, t) in columns.items()}
        out["hot"] = table["hot"].combine_chunks().take(pa.array(to[cut]))
        return pa.table(out)

    def cut_out(group, table: pa.Table, answers: pa.Table) -> pa.Table:
        table = _by_rid(table)
        data, offsets = C.text_bytes(table["text"])
        doc = C.ints(table["doc_id"])
        change = np.zeros(len(data) + 1, np.int32)
        if answers.num_rows:
            content, off, size, least = (np.concatenate(C.blobs(answers[n], t)) for n, t in (("contents", U64), ("offsets", np.uint32), ("lens", np.uint32), ("docs", np.int64)))
            order = np.argsort(content, kind="stable")
            content, off, size, least = content[order], off[order].astype(np.int64), size[order].astype(np.int64), least[order]
            start, wins, key, row, own = _runs(data, offsets, window)
            hot_keys = np.unique(np.concatenate(C.blobs(answers["hot"], U64)))
            split = np.isin(C.truncate(key, bits) + U64(1), hot_keys)
            if split.any():
                at, owner, h = _windows_of(data, offsets, start[split], wins[split], row[split], window)
                start, row, own = (np.concatenate(x) for x in ((start[~split], at), (row[~split], owner), (own[~split], h)))
            # a content has several answers where its windows have several smallest documents
            first, last = np.searchsorted(content, own), np.searchsorted(content, own, side="right")
            src = np.repeat(np.arange(len(own)), last - first)
            hit = _ranges(first, last - first)
            some = least[hit] < doc[row[src]]
            begin = start[src[some]] + off[hit[some]]
            np.add.at(change, begin, 1)
            np.add.at(change, begin + size[hit[some]], -1)
        gone = np.cumsum(change[:-1]) > 0
        edge = np.concatenate([[True], gone[1:] != gone[:-1]]) if len(gone) else gone
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        edge[inner] = True
        begin = np.flatnonzero(edge)
        end = np.append(begin[1:], len(data)) if len(begin) else begin
        begin, end = begin[gone[begin]], end[gone[begin]]
        row = np.searchsorted(offsets, begin, side="right") - 1
        per_row = np.bincount(row, minlength=table.num_rows) if len(row) else np.zeros(table.num_rows, np.int64)
        bounds = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(begin - offsets[row], pa.int64()), pa.array(end - offsets[row], pa.int64())], ["start", "end"])
        spans = pa.ListArray.from_arrays(pa.array(bounds), pairs)
        pa.default_memory_pool().release_unused()
        return table.select(["chunk", "rid", "doc_id", "text"]).append_column("spans", spans)

    shared = C.shared_keys(x.groupBy("chunk").applyInArrow(announce, C.KEYS_SCHEMA))
    found = x.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(segments, SEGMENTS)
    answers = found.groupBy("part").applyInArrow(expand, ANSWERS)
    return x.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        cut_out, "chunk int, rid long, doc_id long, text string, spans array<struct<start:long,end:long>>"
    )


def remove_repeats(docs: DataFrame, min_bytes: int = 50, hot: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary): every text without its repeated bytes.

    The kept bytes needn't be valid UTF-8, since a cut may fall inside a character.
    """

    def kept(batches):
        for b in batches:
            data, offsets = C.text_bytes(b.column("text"))
            out, removed, count = [], [], []
            for i, spans in enumerate(b.column("spans").to_pylist()):
                raw, at, pieces = data[offsets[i] : offsets[i + 1]], 0, []
                for s in spans:
                    pieces.append(raw[at : s["start"]].tobytes())
                    at = s["end"]
                pieces.append(raw[at:].tobytes())
                out.append(b"".join(pieces))
                removed.append(sum(s["end"] - s["start"] for s in spans))
                count.append(len(spans))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(out, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    spans = repeated_spans(docs, min_bytes, hot, id_col, text_col).select("doc_id", "text", "spans")
    return spans.mapInArrow(kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: bytes of documents that a 50-byte string of an earlier document covers, cut out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
