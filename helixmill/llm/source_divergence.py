"""Operator 12, source divergence audit: pair-task sparse merge.

Words are counted by (lang, source, term), summed within tasks first, so a frequent word or a source
with a third of all rows is a few rows a task. Terms that enough documents of a language hold get
ids in the order of (lang, term), by ranges and prefix sums; ids fall into blocks of ``block_terms``. A group's
counts are sorted (id, count) arrays, one a block. Per unordered pair of a language's sources and
block, one task co-groups the two arrays: the longer one is searched by galloping, and shared and
one-sided terms are priced with both groups' shares. Terms that both lack are priced by their number
afterwards, so absent terms cost nothing. A difference holds both ways. No task sees more than two
blocks of one pair.

Shares are integers: ``1 + floor(10^9 (count + 5) / (N + 5 V))``, by long division in 64 bits or by
decimals; a total of 9 * 10^15 words or more is an error, not a rounded share.

Rows: null text, lang and source count as empty ones. Repeated rows count as often as they stand.
A group without kept terms has the share of absent terms; a language without kept terms gives pairs
of value 0 and no terms. Other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm import common as C

COUNTS = "lang string, source string, term string, n long, docs long"
ARRAYS = "lang string, source string, block long, ids binary, counts binary, whole binary"
LIMIT = 9 * 10**15
U64 = np.uint64

_LETTERS = np.ones(256, bool)
_LETTERS[:128] = False
_LETTERS[65:91] = _LETTERS[97:123] = True


# ------------------------------------------------------------------ counting

def count_terms(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Terms of some rows by group: the group, the distinct terms, and for each (group, term) the term's number, occurrences and rows."""
    data = C.lower_ascii(data)
    start, end, row = C.words_of(data, offsets, _LETTERS)
    z = np.zeros(0, np.int64)
    if not len(start):
        return z, [], z, z, z
    number, place = C.numbered(data, start, end)
    terms = [data[a:b].tobytes().decode() for a, b in zip(start[place].tolist(), end[place].tolist())]
    pair, times = np.unique(row * len(terms) + number, return_counts=True)
    key = group[pair // len(terms)] * len(terms) + pair % len(terms)
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    cut = np.flatnonzero(np.diff(key, prepend=-1))
    docs = np.diff(np.append(cut, len(key)))
    return key[cut] // len(terms), terms, key[cut] % len(terms), np.add.reduceat(times, cut), docs


def term_counts(docs: DataFrame, text: Column, lang: Column, source: Column, slice_bytes: int = 1 << 23) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group; a group has one row without a term too."""

    def run(batches):
        for b in batches:
            pairs = pa.StructArray.from_arrays([b["lang"].cast(pa.string()), b["source"].cast(pa.string())], names=["lang", "source"])
            known, group = np.unique(np.array([f"{len(a)}:{a}{s}" for a, s in zip(b["lang"].to_pylist(), b["source"].to_pylist())], object).astype(str), return_inverse=True)
            first = np.zeros(len(known), np.int64)
            first[group[::-1]] = np.arange(len(group))[::-1]
            names = pairs.take(pa.array(first))
            lang_, source_ = names.field(0), names.field(1)
            data, offsets = C.text_bytes(b["text"])
            none = pa.nulls(len(known), pa.string())
            zero = pa.array(np.zeros(len(known), np.int64))
            yield pa.RecordBatch.from_arrays([lang_, source_, none, zero, zero], names=["lang", "source", "term", "n", "docs"])
            for i, j in C.slices(offsets, slice_bytes):
                g, terms, t, n, d = count_terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], group[i:j])
                at = pa.array(g)
                yield pa.RecordBatch.from_arrays(
                    [lang_.take(at), source_.take(at), pa.array(terms, pa.string()).take(pa.array(t)), pa.array(n), pa.array(d)], names=["lang", "source", "term", "n", "docs"]
                )

    plain = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).alias("text"))
    return rows.mapInArrow(run, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# ------------------------------------------------------------------ exact shares

def shares(count, total: int, terms: int):
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), in numpy integers."""
    divisor = total + 5 * terms
    if divisor >= LIMIT:
        raise ValueError("too many words for exact shares in 64 bits")
    rest = np.asarray(count, np.int64) + 5
    out, rest = rest // divisor, rest % divisor
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // divisor, rest % divisor
    return out + 1


def gallop(short: np.ndarray, long_: np.ndarray, stride: int = 256) -> np.ndarray:
    """Index of the first value of ``long_`` that isn't below each of ``short``, both ascending.

    From where the last stride ended, the reach doubles until it passes the stride's last value; only
    what lies within is searched. So a far shorter array costs its own length times a logarithm.
    """
    out, low = np.empty(len(short), np.int64), 0
    for i in range(0, len(short), stride):
        some = short[i : i + stride]
        reach = 1
        while low + reach < len(long_) and long_[low + reach] < some[-1]:
            reach *= 2
        out[i : i + stride] = low + np.searchsorted(long_[low : low + reach + 1], some)
        low = int(out[min(i + stride, len(short)) - 1])
    return out


def price(a: tuple, b: tuple, terms: int) -> tuple[int, int]:
    """Sum of the shares' differences over the terms that either side has, and their number. A side: (ids, counts, total)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    (ids, counts, total), (ids_, counts_, total_) = a, b
    at = gallop(ids, ids_)
    both = at < len(ids_)
    both[both] = ids_[at[both]] == ids[both]
    alone = np.ones(len(ids_), bool)
    alone[at[both]] = False
    mine, theirs = shares(counts, total, terms), shares(counts_, total_, terms)
    value = np.abs(mine[both] - theirs[at[both]]).sum() + np.abs(mine[~both] - shares(0, total_, terms)).sum() + np.abs(theirs[alone] - shares(0, total, terms)).sum()
    return int(value), len(ids_) + int((~both).sum())


def _share(n: str, total: str, terms: str) -> str:
    """The same by decimals, as a SQL expression."""
    wide = lambda e: f"cast({e} as decimal(20, 0))"
    return f"(1 + ({wide(n + ' + 5')} * cast(1000000000 as decimal(10, 0))) div {wide(f'{total} + 5 * {terms}')})"


# ------------------------------------------------------------------ the audit

def _kept_terms(counts: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, whole, id): the terms of enough documents; ids count up in the order of (lang, term)."""
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("whole"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = kept.drop("docs").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").withColumn("mark", F.monotonically_increasing_id())
    kept = C.materialize(kept.select("lang", "term", "whole", F.shiftright("mark", 33).alias("part"), F.col("mark").bitwiseAND(2**33 - 1).alias("at")), "kept-terms")
    sizes = kept.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return kept.join(F.broadcast(base), "part").select("lang", "term", "whole", (F.col("base") + F.col("at")).alias("id"))


def divergence(
    docs: DataFrame, min_docs: int = 30, top: int = 50, block_terms: int = 1 << 13, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source's words are from every other source of its language, and by which terms from the language."""
    counts = C.materialize(term_counts(docs, C.named(text_col), C.named(lang_col), C.named(source_col)), "term-counts")
    kept = C.materialize(_kept_terms(counts, min_docs), "term-ids")
    have = counts.where("term is not null").join(kept, ["lang", "term"]).select("lang", "source", "id", "n", "whole")

    def sort(table: pa.Table) -> pa.Table:
        ids = C.ints(table["id"])
        order = np.argsort(ids)
        column = lambda name: pa.array([C.ints(table[name])[order].tobytes()], pa.binary())
        return pa.table({c: table[c].slice(0, 1) for c in ("lang", "source", "block")} | {"ids": column("id"), "counts": column("n"), "whole": column("whole")})

    arrays = have.withColumn("block", F.expr(f"id div {block_terms}")).groupBy("lang", "source", "block").applyInArrow(sort, ARRAYS)
    arrays = C.materialize(arrays, "term-arrays")

    def add(batches):
        for b in batches:
            total = [int(x.sum()) for x in C.blobs(b["counts"], np.int64)]
            yield pa.RecordBatch.from_arrays([b["lang"], b["source"], pa.array(total, pa.int64())], names=["lang", "source", "n"])

    sums = arrays.select("lang", "source", "counts").mapInArrow(add, "lang string, source string, n long").groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("whole").alias("whole_total"))
    groups = counts.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = C.materialize(groups.na.fill(0, ["total", "terms", "whole_total"]), "term-groups")
    pairs, terms = _pairs(groups, arrays), _terms(groups, arrays, kept, top)
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def _pairs(groups: DataFrame, arrays: DataFrame) -> DataFrame:
    side = lambda s: groups.select("lang", "terms", F.col("source").alias(s), F.col("total").alias(f"total_{s}"))
    pairs = C.materialize(side("a").join(side("b"), ["lang", "terms"]).where("a < b"), "source-pairs")  # the answer has as many rows

    def both(key, left: pa.Table, right: pa.Table) -> pa.Table:
        some = left if left.num_rows else right
        terms, totals = some["terms"][0].as_py(), (some["total_a"][0].as_py(), some["total_b"][0].as_py())
        load = lambda t, n: (np.concatenate([np.zeros(0, np.int64), *C.blobs(t["ids"], np.int64)]), np.concatenate([np.zeros(0, np.int64), *C.blobs(t["counts"], np.int64)]), n)
        value, either = price(load(left, totals[0]), load(right, totals[1]), terms)
        return pa.table({"lang": [key[0].as_py()], "a": [key[1].as_py()], "b": [key[2].as_py()], "value": pa.array([value]), "either": pa.array([either])})

    keys = ["lang", "a", "b", "block"]
    blocks = arrays.select("lang", "source", "block", "ids", "counts")
    left, right = (pairs.join(blocks.withColumnRenamed("source", s), ["lang", s]) for s in ("a", "b"))
    right = right.select(*[F.col(k).alias(f"{k}_") for k in keys], *[F.col(c).alias(c) for c in ("terms", "total_a", "total_b", "ids", "counts")])
    parts = left.groupBy(*keys).cogroup(right.groupBy(*[f"{k}_" for k in keys])).applyInArrow(both, "lang string, a string, b string, value long, either long")
    parts = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("either").alias("either"))
    absent = f"(terms - coalesce(either, 0)) * abs({_share('0', 'total_a', 'terms')} - {_share('0', 'total_b', 'terms')})"
    value = F.expr(f"case when terms = 0 then 0 else coalesce(value, 0) + {absent} end").cast("long")
    done = pairs.join(parts, ["lang", "a", "b"], "left").select("lang", "a", "b", value.alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    out = done.select("lang", ways.alias("way"), "value").select("lang", "way.*", "value")
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return out.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by).alias("rank"))


def _terms(groups: DataFrame, arrays: DataFrame, kept: DataFrame, top: int) -> DataFrame:
    """The ``top`` terms of each group above its language. Each block gives its best ones, by id among equals, as ids are in the order of terms."""
    schema = "lang string, source string, id long, value long"

    def best(batches):
        for b in batches:
            rows = zip(C.blobs(b["ids"], np.int64), C.blobs(b["counts"], np.int64), C.blobs(b["whole"], np.int64), b["total"].to_pylist(), b["whole_total"].to_pylist(), b["terms"].to_pylist())
            index, ids, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, (id_, n, whole, total, whole_total, terms) in enumerate(rows):
                gap = shares(n, total, terms) - shares(whole, whole_total, terms)
                above = np.flatnonzero((gap > 0) & (n > 0))
                above = above[np.argsort(-gap[above], kind="stable")[:top]]
                index.append(np.full(len(above), i))
                ids.append(id_[above])
                values.append(gap[above])
            at = pa.array(np.concatenate(index))
            yield pa.RecordBatch.from_arrays([b["lang"].take(at), b["source"].take(at), pa.array(np.concatenate(ids)), pa.array(np.concatenate(values))], names=["lang", "source", "id", "value"])

    found = arrays.join(groups, ["lang", "source"]).select("lang", "source", "ids", "counts", "whole", "total", "whole_total", "terms").mapInArrow(best, schema)
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "id")
    found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return found.join(kept.select("id", F.col("term").alias("item")), "id").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: all pairs of sources of a language, and each source's 50 terms furthest above its language."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
g as (select distinct lang, source from d),
w as (select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term, count(*) as whole from w group by lang, term having count(distinct r) >= 30),
l as (select lang, count(*) as v, sum(whole) as n from k group by lang),
c as (select w.lang, w.source, w.term, count(*) as n from w join k using (lang, term) group by all),
s as (select lang, source, sum(n) as n from c group by all),
p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as cnt, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (coalesce(s.n, 0) + 5 * l.v) as p,
    1 + (1000000000::hugeint * (k.whole + 5)) // (l.n + 5 * l.v) as q
  from g join k on k.lang = g.lang join l on l.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term
  left join s on s.lang = g.lang and s.source = g.source),
f as (
  select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(x.value, 0) as bigint) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all) x
    on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all select lang, source, 'term', term, cast(p - q as bigint) from p where cnt > 0 and p > q)
select lang, source, part, item, value, cast(rank as integer) as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from f) z where part = 'pair' or rank <= 50
"""
