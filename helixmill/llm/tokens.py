"""Token ids by a public tokenizer, one lookup for each different word of some rows.

The vocabulary drops white space and never merges across it, so a text's ids are those of its words
in order. Each Python worker keeps the ids of words it has met (some ``CACHE`` of them, the latest); only
new words go through the tokenizer, in batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from helixmill.llm import common as C

CACHE = 1_500_000  # words, some 60 MB
SLICE = 1 << 22  # bytes of text that are worked on at a time
_TRAIL = b".,;:!?%$#*&|"
_STATE: dict[str, tuple] = {}


def tokenizer_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Known:
    """Ids of words that were met, as arrays sorted by the word's hash: some 40 bytes a word."""

    def __init__(self):
        self.hash, self.low, self.high = (np.zeros(0, np.uint64) for _ in range(3))
        self.size, self.begin, self.count = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, np.uint32)

    def find(self, hash_, low, high, size) -> np.ndarray:
        """Where each word stands, -1 for those that aren't known. Words are told apart by their keys and length."""
        if not len(self.hash):
            return np.full(len(hash_), -1)
        at = np.minimum(np.searchsorted(self.hash, hash_), len(self.hash) - 1)
        same = (self.hash[at] == hash_) & (self.low[at] == low) & (self.high[at] == high) & (self.size[at] == size)
        return np.where(same, at, -1)

    def take(self, at) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, the number of each) of words that are known."""
        count = self.count[at]
        return self.ids[np.repeat(self.begin[at] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))], count

    def add(self, hash_, low, high, size, ids, count) -> None:
        begin = np.cumsum(count) - count + len(self.ids)
        both = [np.concatenate(x) for x in ((self.hash, hash_), (self.low, low), (self.high, high), (self.size, size), (self.begin, begin), (self.count, count))]
        order = np.argsort(both[0], kind="stable")
        self.hash, self.low, self.high, self.size, self.begin, self.count = (x[order] for x in both)
        self.ids = np.concatenate([self.ids, ids])


def _load(path: str) -> tuple:
    if path not in _STATE:
        from tokenizers import Tokenizer

        _STATE[path] = (Tokenizer.from_file(path), _Known())
    return _STATE[path]


def _fresh(words: list[bytes], model) -> list[bytes]:
    """Ids of different words. Trailing ASCII punctuation splits off after a letter or digit, as the tokenizer's own pattern does."""
    stems = [w.rstrip(_TRAIL) for w in words]
    parts = [(s, w[len(s) :]) if len(s) < len(w) and s[-1:].isalnum() else (w,) for w, s in zip(words, stems)]
    need, ids = list({x for p in parts for x in p}), {}
    for i in range(0, len(need), 4096):
        some = need[i : i + 4096]
        for w, e in zip(some, model.encode_batch_fast([x.decode() for x in some], add_special_tokens=False)):
            ids[w] = np.array(e.ids, np.uint32).tobytes()
    return [b"".join(map(ids.__getitem__, p)) for p in parts]


def _encode(data: np.ndarray, offsets: np.ndarray, model, known: _Known, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of rows end to end, and how many each row has."""
    rows = len(offsets) - 1
    row_of = lambda at: np.unique(np.searchsorted(offsets, at, side="right") - 1)
    marks = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if len(data) > 1 else np.zeros(0, np.int64)
    own = np.searchsorted(offsets, marks, side="right") - 1
    whole = np.unique(own[marks + 1 < offsets[own + 1]])
    low = C.lower_ascii(data)
    for r in row_of(np.flatnonzero((data == 0xCC) | (data == 0xCD))).tolist():
        low[offsets[r] : offsets[r + 1]] = data[offsets[r] : offsets[r + 1]]
    start, end, row = C.words_of(low, offsets)
    if len(whole):
        rest = ~np.isin(row, whole)
        start, end, row = start[rest], end[rest], row[rest]
    # each different word is looked up once, and its ids go to all its places
    number, place = C.numbered(low, start, end)
    first_, last_ = start[place], end[place]
    keys = (*C.word_keys(low, first_, last_), last_ - first_)
    hash_ = C.mix(keys[0] ^ C.mix(keys[1] + keys[2].astype(np.uint64)))
    at = known.find(hash_, *keys)
    new = np.flatnonzero(at < 0)
    raw = low.tobytes()
    fresh = _fresh([raw[a:b] for a, b in zip(first_[new].tolist(), last_[new].tolist())], model)
    more, many = np.frombuffer(b"".join(fresh), np.uint32), np.fromiter(map(len, fresh), np.int64, len(fresh)) // 4
    old = np.flatnonzero(at >= 0)
    have, each = known.take(at[old])
    flat, length, begin = np.concatenate([have, more]), np.empty(len(place), np.int64), np.empty(len(place), np.int64)
    length[old], length[new] = each, many
    begin[old], begin[new] = np.cumsum(each) - each, np.cumsum(many) - many + len(have)
    if len(known.hash) > CACHE:  # what these rows have as well stays
        known.__init__()
        known.add(hash_[old], *(k[old] for k in keys), have, each)
    if len(new):
        known.add(hash_[new], *(k[new] for k in keys), more, many)
    size = length[number]
    ids = flat[np.repeat(begin[number] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    per_row = np.bincount(row, weights=size, minlength=rows).astype(np.int64)
    special = {r: np.array(model.encode(data[offsets[r] : offsets[r + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32) for r in whole.tolist()}
    ends = 0 if end_id is None else 1
    count = per_row + ends
    for r, x in special.items():
        count[r] += len(x)
    first = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.uint32)
    out[np.repeat(first - (np.cumsum(per_row) - per_row), per_row) + np.arange(len(ids))] = ids
    for r, x in special.items():
        out[first[r] : first[r] + len(x)] = x
    if ends:
        out[first + count - 1] = end_id
    return out, count


def encode_rows(column, path: str, end_id: int | None = 1) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows end to end, the number of each row's) of a string column, each row's followed by ``end_id``. A null text is empty.

    Words split at ASCII white space. ASCII letters are lower-cased first, unless a combining mark might
    compose with one. A text with ``<|`` (special tokens) goes through whole.
    """
    model, known = _load(path)
    data, offsets = C.text_bytes(column)
    done = [_encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], model, known, end_id) for i, j in C.slices(offsets, SLICE)]
    if not done:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in done]), np.concatenate([n for _, n in done])


def encode_all(texts: list[str | None], path: str, end_id: int | None = 1) -> list[bytes]:
    """Little-endian 32-bit ids of every text, as ``encode_rows`` gives them."""
    ids, count = encode_rows(pa.array(texts, pa.string()), path, end_id)
    raw, ends = ids.tobytes(), np.cumsum(count) * 4
    return [raw[b - 4 * n : b] for b, n in zip(ends.tolist(), count.tolist())]
