"""Vocabularies, encoding and decoding."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.constants import MAX_LENGTH, SPECIAL_TOKENS
from helixmill.functions.arrays import text_bytes, token_codes, token_spans
from helixmill.functions.barrier import held


def build_vocab(df: DataFrame, col: str) -> DataFrame:
    """(token, token_id): <blank> is 0, tokens follow in code-point order, <MASK> is last."""
    blank, mask = SPECIAL_TOKENS

    def distinct(batches):
        for b in batches:
            data, offsets = text_bytes(b.column(0))
            code, texts = token_codes(data, *token_spans(data, offsets)[:2])
            yield pa.RecordBatch.from_arrays([pa.array([*map(chr, np.unique(code[code < 128]).tolist()), *texts], pa.string())], names=["token"])

    tokens = df.select(F.col(col).cast("string")).mapInArrow(distinct, "token string").where(~F.col("token").isin(*SPECIAL_TOKENS)).distinct()
    # the alphabet: its size doesn't grow with the rows. In one row, so that the texts aren't gone over again to count it
    alphabet = tokens.agg(F.array_sort(F.collect_set("token")).alias("all"))
    both_ends = F.concat(F.array(F.lit(blank)), "all", F.array(F.lit(mask)))
    return alphabet.select(F.posexplode(both_ends).alias("token_id", "token")).select("token", "token_id")


def resolve_vocab(fresh: DataFrame, saved: DataFrame) -> DataFrame:
    """The saved ids if they cover all fresh tokens, else the fresh ones."""
    missing = fresh.join(saved.select("token"), "token", "left_anti").agg(F.count("*").alias("missing"))
    both = saved.withColumn("s", F.lit(True)).unionByName(fresh.withColumn("s", F.lit(False)))
    return both.join(F.broadcast(missing), F.col("s") == (F.col("missing") == 0)).select("token", "token_id")


LARGEST = 1 << 16  # tokens that are broadcast; more are an error


def _broadcast(vocab: DataFrame, *columns) -> DataFrame:
    """One row of ``columns`` over the vocabulary, whose size is checked before it is broadcast."""
    fits = F.assert_true(F.count("*") <= LARGEST, F.lit(f"a vocabulary of more than {LARGEST} tokens can't be broadcast"))
    row = vocab.agg(fits.alias("_fits"), *columns)
    return F.broadcast(row.where("_fits is null").drop("_fits"))


def encode(df: DataFrame, vocab: DataFrame, col: str, max_length: int = MAX_LENGTH, on_error: str = "raise") -> DataFrame:
    """Adds ``ids``, padded with 0. Unknown tokens and long texts raise, or with 'reject' give NULL ids.

    The vocabulary is read when this is called, and goes to the tasks with the function that looks tokens up.
    """
    rows = vocab.select("token", F.col("token_id").cast("int")).limit(LARGEST + 1).collect()
    if len(rows) > LARGEST:
        raise ValueError(f"a vocabulary of more than {LARGEST} tokens can't be broadcast")
    known = {token: i for token, i in rows if i is not None}
    if len({token for token, _ in rows}) < len(rows):
        raise ValueError("a token has several ids")

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        data, offsets = text_bytes(column)
        start, end, row = token_spans(data, offsets)
        code, texts = token_codes(data, start, end)
        # an unknown token's id may be any number, so it is marked beside
        ids = [known.get(t) for t in (*map(chr, range(128)), *texts)]
        found, ids = np.array([i is not None for i in ids]), np.array([i or 0 for i in ids], np.int32)
        size = np.bincount(row, minlength=len(column))
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        bad = (size > max_length) | (np.bincount(row[~found[code]], minlength=len(column)) > 0) | column.is_null().to_numpy(zero_copy_only=False)
        out, fits = np.zeros((len(column), max_length), np.int32), at < max_length
        out[row[fits], at[fits]] = ids[code[fits]]
        ends = pa.array(np.arange(len(column) + 1, dtype=np.int32) * max_length)
        return pa.ListArray.from_arrays(ends, pa.array(out.ravel()), mask=pa.array(bad) if bad.any() else None)

    d = held(df.withColumn("ids", run(F.col(col).cast("string"))))
    if on_error != "raise":
        return d
    bad = F.raise_error(F.concat(F.lit("unknown token or too long: "), F.col(col))).cast("array<int>")
    return held(d.withColumn("ids", F.coalesce("ids", bad)))


def one_hot_long(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.posexplode("ids").alias("pos", "token_id"))


def decode_ids(df: DataFrame, vocab: DataFrame, length_col: str | None = None) -> DataFrame:
    """Adds ``decoded``: the first ids' tokens, ``?`` for an unknown id."""
    d = df.crossJoin(_broadcast(vocab, F.map_from_entries(F.collect_list(F.struct("token_id", "token"))).alias("_vocab")))
    ids = F.slice("ids", F.lit(1), F.col(length_col)) if length_col else F.col("ids")
    return d.withColumn("decoded", F.array_join(F.transform(ids, lambda x: F.coalesce(F.try_element_at("_vocab", x), F.lit("?"))), "")).drop("_vocab")


def decode_argmax(scores: DataFrame, vocab: DataFrame) -> DataFrame:
    """(item_id, decoded): best token a position, ties to the lowest id, in order."""
    # dealt out by item first: one shuffle serves both aggregations, and no task before it sorts all that it reads
    best = scores.repartition("item_id").groupBy("item_id", "pos").agg(F.max_by("token_id", F.struct("score", -F.col("token_id"))).alias("token_id"))
    named = best.join(F.broadcast(vocab), "token_id")
    ordered = named.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t"))
    return ordered.select("item_id", F.array_join("t.token", "").alias("decoded"))


def effective_length(ids, pad: int = 0):
    return F.size(F.filter(ids, lambda x: x != pad))
