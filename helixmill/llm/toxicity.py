"""Operator 6, toxicity: a convolutional text classifier, trained in numpy.

A word's embedding is the sum of the hashed embeddings of the word and of its first four and five
bytes, so that inflections of a stem share weight. Filters of widths 1, 2 and 3 slide over the
words; each gives its largest response in the text (max pooling); a linear layer makes a logit.
Adam trains all layers on every labelled text, whole. Executors turn the texts into bucket numbers,
six bytes a word, in shards by hash of the id (``SHARD_ROWS`` rows, ``SHARD_BYTES``; a row of a written
table each). In each epoch every shard is trained from the same state by one task, and the states are
averaged, piece by piece, by others; the driver sees the average, which has a fixed size. A single
shard is plain training. The first embedding component starts as the log-odds of its bucket.

A fourth of each shard is kept from training to calibrate: for each language, as told from the text's
own function words, the logit that separates the classes best becomes the score ``threshold``. The
score is a logistic function of the logit's distance to it.

Rows: a null or empty text has no words and scores 0. All rows are scored (to six decimals), repeated
ones alike; other columns are ignored. Without both classes among the labels every score is 0
(nothing counts as toxic).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from helixmill.llm import common as C
from helixmill.llm.labelled import held_out, labelled, score_batches

U64 = np.uint64
WIDTHS = (1, 2, 3)
SHARD_ROWS, SHARD_BYTES, PIECES, BATCH_WORDS = 4000, 1 << 24, 64, 1 << 17
#: bytes of text that are looked at at a time; some 40 bytes of temporaries come to one
SLICE = 1 << 19
#: logits count for calibration in steps of 1/256, up to this
LOGIT = 64
# fixed values: frequent function words by language
FUNCTION_WORDS = {
    "en": "the of and to in is that it for with on at from this be are or by an was".split(),
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch".split(),
    "fr": "le la les et des en un une du que qui dans est pour pas au sur ne se par".split(),
    "es": "el los las y que en un por con no una su para es al lo como más o del".split(),
}


def _hash(word: str) -> int:
    d = np.frombuffer(word.encode(), np.uint8)
    return int(C.span_hash(C.prefix_hash(d), np.array([0]), np.array([len(d)]))[0])


def _features(data: np.ndarray, offsets: np.ndarray, buckets: int):
    """(row, word hash, 3 buckets) of every word, lower-cased, without surrounding punctuation."""
    data = C.lower_ascii(data)
    letters = ((data >= 97) & (data <= 122)) | (data >= 128) | ((data >= 48) & (data <= 57))
    start, end, row = C.words_of(np.where(letters, data, np.uint8(32)), offsets)
    prefix = C.prefix_hash(data)
    whole = C.span_hash(prefix, start, end)
    b = np.empty((len(start), 3), np.int32)
    b[:, 0] = whole % U64(buckets)
    for k, n in ((1, 4), (2, 5)):
        cut = np.minimum(end, start + n)
        b[:, k] = C.mix(C.span_hash(prefix, start, cut) + U64(k)) % U64(buckets)
    return row, whole, b


def _word_table() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all function words, and which languages have each (a row a word)."""
    words = sorted({w for of in FUNCTION_WORDS.values() for w in of}, key=_hash)
    return np.array([_hash(w) for w in words], U64), np.array([[w in of for of in FUNCTION_WORDS.values()] for w in words], float)


_WORDS, _OF = _word_table()


def _languages(row: np.ndarray, whole: np.ndarray, n: int) -> np.ndarray:
    """The language of every text by its function words; the number after the last for none."""
    at = np.minimum(np.searchsorted(_WORDS, whole), len(_WORDS) - 1)
    hit = np.flatnonzero(_WORDS[at] == whole)
    votes = np.stack([np.bincount(row[hit], _OF[at[hit], k], minlength=n) for k in range(len(FUNCTION_WORDS))])
    return np.where(votes.max(0) > 0, votes.argmax(0), len(FUNCTION_WORDS))


class Model:
    def __init__(self, buckets=1 << 15, dim=8, filters=8, seed=11):
        r = np.random.default_rng(seed)
        self.buckets, self.dim, self.filters = buckets, dim, filters
        self.p = {"E": r.normal(0, 0.05, (buckets, dim)).astype(np.float32), "v": r.normal(0, 0.3, filters * len(WIDTHS)).astype(np.float32), "b": np.zeros(1, np.float32)}
        for w in WIDTHS:
            self.p[f"W{w}"] = r.normal(0, 0.3, (w, dim, filters)).astype(np.float32)
            self.p[f"c{w}"] = np.zeros(filters, np.float32)
        half = filters // 2
        for i, w in enumerate(WIDTHS):  # half of the filters look along the first component
            self.p[f"W{w}"][:, 0, :half] = np.abs(self.p[f"W{w}"][:, 0, :half]) + 0.3
            self.p["v"][i * filters : i * filters + half] = 0.3
        self.thresholds: dict[str, float] = {}
        self.trained = False

    def _pool(self, row, emb, n, want=False):
        """Pooled responses (n, filters * widths) and, if wanted, the position of each, -1 for none."""
        out, at = np.zeros((n, self.filters * len(WIDTHS)), np.float32), np.full((n, self.filters * len(WIDTHS)), -1)
        if not len(row):
            return out, at
        heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        rows = row[heads]
        for i, w in enumerate(WIDTHS):
            resp = emb @ self.p[f"W{w}"][0] + self.p[f"c{w}"]
            for j in range(1, w):
                inside = row[j:] == row[:-j]
                resp[:-j][inside] += (emb[j:] @ self.p[f"W{w}"][j])[inside]
            best = np.maximum.reduceat(resp, heads, axis=0)
            cols = slice(i * self.filters, (i + 1) * self.filters)
            out[rows, cols] = np.maximum(best, 0)
            if want:
                equal = resp == np.repeat(best, np.diff(np.append(heads, len(row))), axis=0)
                for f in range(self.filters):
                    hit = np.flatnonzero(equal[:, f])
                    first = hit[np.searchsorted(hit, heads)]
                    at[rows, i * self.filters + f] = np.where(best[:, f] > 0, first, -1)
        return out, at

    def _embed(self, b):
        e = self.p["E"]
        return e[b[:, 0]] + e[b[:, 1]] + e[b[:, 2]]

    def gradients(self, rows, b, y):
        """Gradients of the mean logistic loss over ``y``'s texts; ``rows``, ``b``: text and buckets of every word."""
        p, n = self.p, len(y)
        emb = self._embed(b)
        pooled, at = self._pool(rows, emb, n, True)
        d = (1 / (1 + np.exp(-(pooled @ p["v"] + p["b"]))) - y).astype(emb.dtype) / n
        g = {"v": pooled.T @ d, "b": np.array([d.sum()], emb.dtype)}
        ge = np.zeros_like(emb)
        for i, w in enumerate(WIDTHS):
            gw, gc = np.zeros_like(p[f"W{w}"]), np.zeros_like(p[f"c{w}"])
            for f in range(self.filters):
                k = i * self.filters + f
                ok = at[:, k] >= 0
                x, dz = at[ok, k], d[ok] * p["v"][k]
                gc[f] = dz.sum()
                for j in range(w):
                    xj = np.minimum(x + j, len(rows) - 1)
                    inside = (x + j < len(rows)) & (rows[xj] == rows[x])
                    gw[j, :, f] = (emb[xj[inside]] * dz[inside, None]).sum(0)
                    np.add.at(ge, xj[inside], dz[inside, None] * p[f"W{w}"][j][:, f])
            g[f"W{w}"], g[f"c{w}"] = gw, gc
        touched = np.flatnonzero(np.abs(ge).sum(1))
        g["E"] = np.zeros_like(p["E"])
        for k in range(3):
            np.add.at(g["E"], b[touched, k], ge[touched])
        return g

    def start(self, seen: np.ndarray, n: np.ndarray):
        """``seen``: how many texts of each class have each bucket; ``n``: how many there are."""
        odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
        self.p["E"][:, 0] = np.where(seen.sum(0) > 2, np.clip(odds / 3, -1, 2), 0)
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.s = {k: np.zeros_like(v) for k, v in self.p.items()}

    def _step(self, some: list[np.ndarray], y) -> dict:
        """Gradients of a batch, a bounded number of words at a time."""
        ends = np.cumsum([len(b) for b in some])
        g: dict = {}
        for i, j in C.slices(np.concatenate([[0], ends]), BATCH_WORDS):
            part = self.gradients(np.repeat(np.arange(j - i), [len(b) for b in some[i:j]]), np.concatenate(some[i:j]), y[i:j])
            g = {k: g.get(k, 0) + v * np.float32((j - i) / len(y)) for k, v in part.items()}
        return g

    def epoch(self, texts: list[np.ndarray], y, number: int, shard: int = 0, batch=128, rate=0.02, seed=3) -> int:
        """One pass over a shard's texts, the (words, 3) buckets of each; the number of its steps."""
        n, p = len(y), self.p
        r = np.random.default_rng([seed, shard] if shard else seed)
        for _ in range(number):
            r.permutation(n)
        picks = np.array_split(r.permutation(n), max(1, n // batch))
        for t, pick in enumerate(picks, number * len(picks) + 1):
            g = self._step([texts[i] for i in pick], y[pick])
            for k in p:
                self.m[k] += 0.1 * (g[k] - self.m[k])
                self.s[k] += 0.01 * (g[k] * g[k] - self.s[k])
                p[k] -= rate * (self.m[k] / (1 - 0.9**t)) / (np.sqrt(self.s[k] / (1 - 0.99**t)) + 1e-6)
        return len(picks)

    def state(self) -> np.ndarray:
        return np.concatenate([d[k].ravel() for d in (self.p, self.m, self.s) for k in self.p]).astype(np.float32)

    def restore(self, state: np.ndarray):
        at = 0
        for d in (self.p, self.m, self.s):
            for k, v in list(d.items()):
                d[k] = state[at : at + v.size].reshape(v.shape).copy()
                at += v.size

    def respond(self, texts: list[np.ndarray]) -> np.ndarray:
        """The logit of every text, given as buckets; a few texts at a time."""
        out = [np.zeros(0)]
        for i in range(0, len(texts), 100):
            some = texts[i : i + 100]
            rows = np.repeat(np.arange(len(some)), [len(b) for b in some])
            pooled, _ = self._pool(rows, self._embed(np.concatenate(some)), len(some))
            out.append(pooled @ self.p["v"] + self.p["b"])
        return np.concatenate(out)

    def logits(self, data, offsets):
        """(logit, language) of every text; that of a text without words is minus infinity."""
        n = len(offsets) - 1
        row, whole, b = _features(data, offsets, self.buckets)
        pooled, _ = self._pool(row, self._embed(b), n)
        words = np.bincount(row, minlength=n)
        return np.where(words > 0, pooled @ self.p["v"] + self.p["b"], -np.inf), _languages(row, whole, n)

    def calibrate(self, logit, language, y, n, least=20):
        """Per language the cut with the best F1, in the middle of its gap; the cut over all where data are few.

        ``n``: how many texts have that logit, language and label.
        """

        def cut(z, t, n):
            order = np.argsort(-z, kind="stable")
            z, t, n = z[order], (t * n)[order], n[order]
            tp = np.cumsum(t)
            f1 = 2 * tp / (np.cumsum(n) + t.sum())
            f1[:-1][z[:-1] == z[1:]] = -1
            k = int(f1.argmax())
            return float((z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 1)

        whole = cut(logit, y, n)
        for i in range(len(FUNCTION_WORDS) + 1):
            here = language == i
            enough = min(n[here & (y == 1)].sum(), n[here & (y == 0)].sum()) >= least
            self.thresholds[i] = cut(logit[here], y[here], n[here]) if enough else whole
        self.trained = True

    def score(self, data, offsets, threshold=0.7):
        if not self.trained:
            return np.zeros(len(offsets) - 1)
        z, language = self.logits(data, offsets)
        shift = np.array([self.thresholds[i] for i in range(len(FUNCTION_WORDS) + 1)])[language]
        # to six decimals: equal texts at other places of a batch may differ in a product's last bits
        return np.round(1 / (1 + np.exp(-np.clip(z - shift + np.log(threshold / (1 - threshold)), -50, 50))), 6)


def _shard(b, i: int, calibrate_every: int):
    """Of row ``i`` of the shards: labels, languages, the texts' buckets and which texts are kept for calibration."""
    y, language, size = (np.frombuffer(b.column(c)[i].as_buffer(), np.int64) for c in ("y", "language", "size"))
    words = np.frombuffer(b.column("words")[i].as_buffer(), np.uint16).reshape(-1, 3)
    apart = np.zeros(len(y), bool)
    for c in (0, 1):
        apart[np.flatnonzero(y == c)[::calibrate_every]] = True
    return y, language, np.split(words, np.cumsum(size)[:-1]), apart


def _shards(docs: DataFrame, labels: DataFrame, learn_from, buckets: int) -> tuple[DataFrame, int, int]:
    """All labelled texts as buckets, a row a shard, in a written table; how many texts and classes there are."""

    def describe(batches):
        for b in batches:
            data, offsets = C.text_bytes(b.column("text"))
            words, language = [], [np.zeros(0, np.int64)]
            for i, j in C.slices(offsets, SLICE):
                row, whole, k = _features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], buckets)
                begin = np.searchsorted(row, np.arange(j - i + 1))
                words += [k[x:z].astype(np.uint16).tobytes() for x, z in zip(begin, begin[1:])]
                language.append(_languages(row, whole, j - i))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("y"), pa.array(np.concatenate(language).astype(np.int32)), pa.array(words, pa.binary())], names=["doc_id", "y", "language", "words"]
            )

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        words = C.blobs(table["words"], np.uint8)
        cells = [C.ints(table["y"], np.int64).tobytes(), C.ints(table["language"], np.int64).tobytes(), np.array([len(w) // 6 for w in words], np.int64).tobytes(), b"".join(words)]
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), **{c: pa.array([v], pa.binary()) for c, v in zip(("y", "language", "size", "words"), cells)}})

    rows = labelled(docs, labels, "toxic", learn_from)
    rows = C.materialize(rows.mapInArrow(describe, "doc_id long, y int, language int, words binary"), "toxic-words", release=True)
    n, classes, size = rows.agg(F.count("*"), F.countDistinct("y"), F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()
    shards = max(1, -(-n // SHARD_ROWS), -(-size // SHARD_BYTES))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).repartition(shards, "shard")
    packed = rows.groupBy("shard").applyInArrow(pack, "shard int, y binary, language binary, size binary, words binary")
    return C.materialize(packed, "toxic-shards", release=True), n, classes


def train(docs: DataFrame, labels: DataFrame, learn_from, calibrate_every: int = 4, epochs: int = 8) -> Model:
    """Fit and calibrate on all labelled rows; every fourth is for calibration."""
    model = Model()
    shards, n, classes = _shards(docs, labels, learn_from, model.buckets)
    if n < 8 or classes < 2:
        return model
    buckets, spark = model.buckets, docs.sparkSession

    def count(batches):
        seen = np.zeros((2, buckets + 1), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                y, _, texts, apart = _shard(b, i, calibrate_every)
                for k in np.flatnonzero(~apart):
                    seen[y[k], np.unique(texts[k])] += 1
                    seen[y[k], buckets] += 1
        label, bucket = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(seen[label, bucket])], names=["y", "bucket", "n"])

    seen = np.zeros((2, buckets + 1))
    got = shards.mapInArrow(count, "y int, bucket int, n long").groupBy("y", "bucket").agg(F.sum("n").alias("n")).toArrow()
    seen[C.ints(got["y"]), C.ints(got["bucket"])] = C.ints(got["n"])
    model.start(seen[:, :buckets], seen[:, buckets])

    def learn(number, shared):
        def run(batches):
            for b in batches:
                for i in range(b.num_rows):
                    y, _, texts, apart = _shard(b, i, calibrate_every)
                    if apart.all():
                        continue
                    m, shard = Model(), b.column("shard")[i].as_py()
                    m.m, m.s = {k: v for k, v in m.p.items()}, {k: v for k, v in m.p.items()}
                    m.restore(shared.value)
                    m.epoch([texts[k] for k in np.flatnonzero(~apart)], y[~apart], number, shard)
                    parts = np.array_split(m.state(), PIECES)
                    columns = [pa.array(range(PIECES), pa.int32()), pa.array([shard] * PIECES, pa.int32()), pa.array([int((~apart).sum())] * PIECES, pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["piece", "shard", "n", "state"])

        return run

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")  # sums in the same order, whatever the tasks
        weight = C.ints(table["n"]).astype(float)
        total = sum(w * x.astype(float) for w, x in zip(weight, C.blobs(table["state"], np.float32)))
        return pa.table({"piece": pa.array([table["piece"][0].as_py()], pa.int32()), "state": pa.array([(total / weight.sum()).astype(np.float32).tobytes()], pa.binary())})

    for number in range(epochs):
        shared = spark.sparkContext.broadcast(model.state())
        states = shards.mapInArrow(learn(number, shared), "piece int, shard int, n long, state binary")
        got = states.groupBy("piece").applyInArrow(mean, "piece int, state binary").toArrow().sort_by("piece")
        shared.unpersist()
        if not got.num_rows:
            return model
        model.restore(np.concatenate(C.blobs(got["state"], np.float32)))
    shared = spark.sparkContext.broadcast(model)

    def respond(batches):
        for b in batches:
            for i in range(b.num_rows):
                y, language, texts, apart = _shard(b, i, calibrate_every)
                some = np.flatnonzero(apart)
                z = np.round(np.clip(shared.value.respond([texts[k] for k in some]), -LOGIT, LOGIT) * 256).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(z), pa.array(language[some]), pa.array(y[some])], names=["z", "language", "y"])

    got = shards.mapInArrow(respond, "z int, language long, y long").groupBy("z", "language", "y").agg(F.count("*").alias("n")).toArrow()
    got = got.sort_by([("z", "ascending"), ("language", "ascending"), ("y", "ascending")])
    model.calibrate(C.ints(got["z"]) / 256, C.ints(got["language"]), C.ints(got["y"]), C.ints(got["n"]))
    return model


def scored(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size, whatever the data

    def run(batches):
        m = shared.value
        yield from score_batches(lambda d, o: m.score(d, o, threshold))(batches)

    return rows.mapInArrow(run, "doc_id long, score double")


def below(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose own text scores less than ``threshold``, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            data, offsets = C.text_bytes(b.column(1))
            out = [shared.value.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], threshold) for i, j in C.slices(offsets, SLICE)]
            keep = np.concatenate(out) < threshold if out else np.zeros(0, bool)
            yield b.select([0]).filter(pa.array(keep))

    rows = docs.select(F.struct(*[C.named(c) for c in docs.columns]).alias("i"), C.named(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, StructType([StructField("i", docs.schema)])).select("i.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: toxicity of every document; labels of rows with crc32(doc_id) mod 3 = 1 are held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = scored(docs, train(docs, labels, ~held_out(F.col("doc_id"), 3, 1)))
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
