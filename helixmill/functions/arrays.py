"""Arrow columns as numpy arrays: a batch of rows at a time, inside tasks."""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# sent along with the functions that use them, so that workers needn't have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and the n + 1 offsets of its rows. Null: empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8), offsets - offsets[0]


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the number in it, from 0, of each of ``counts`` entries a row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def token_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every token of ``sequences.tokenize``: ``<...>`` up to the next ``>``, or a character beside these."""
    opened, closed = data == 60, data == 62
    before = np.cumsum(opened) - opened  # how many open before each byte
    base, starts = np.zeros(len(data), np.int64), offsets[:-1][offsets[:-1] < len(data)]
    after = np.flatnonzero(closed[:-1]) + 1
    base[starts], base[after] = before[starts], before[after]
    inside = before > np.maximum.accumulate(base)  # since the row's start or the last ``>``
    close = np.append(np.flatnonzero(closed), len(data))
    first = ~inside & ~closed & ((data & 0xC0) != 0x80)
    start = np.flatnonzero(first)
    row = np.searchsorted(offsets, start, side="right") - 1
    lead = data[start]
    size = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
    end = np.where(lead == 60, close[np.searchsorted(close, start)] + 1, start + size)
    whole = end <= offsets[row + 1]
    return start[whole], end[whole], row[whole]


def token_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """A number for each token (an ASCII character's is its code), and the texts of all numbers from 128 on."""
    size = end - start
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    kept = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    code = np.zeros(len(start), np.int64)
    code[size == 1] = data[start[size == 1]]
    few, long = np.flatnonzero((size > 1) & (size <= 8)), np.flatnonzero(size > 8)
    words, at = np.unique(np.ndarray(len(data) + 1, "<u8", wide, strides=(1,))[start[few]] & kept[size[few]], return_inverse=True)
    code[few] = 128 + at
    texts = [int(w).to_bytes(8, "little").rstrip(b"\0").decode() for w in words]
    seen, raw = {}, data.tobytes() if len(long) else b""
    for i in long.tolist():
        code[i] = 128 + seen.setdefault(raw[start[i] : end[i]], len(texts) + len(seen))
    return code, texts + [t.decode() for t in seen]
