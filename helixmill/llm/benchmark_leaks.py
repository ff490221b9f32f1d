"""Operator 8, benchmark decontamination: size-partitioned MinHash containment search, native.

Test items are short and documents long, so the search asks which items a document contains, not
which are alike. Items are partitioned by size, in classes of powers of two of their shingle count.
An item's sketch is its k smallest shingle hashes (a bottom-k MinHash); k depends on the class's
upper size u: with containment t at least, at most ``floor((1 - t) * u)`` shingles can be missing, so
a sketch of one more always has a hash in common with the document: no leak is lost. Document
shingles are looked up in the sketches; each (document, item) found is verified by the exact number
of the item's shingles in the document.

Everything is DataFrame expressions. Item tables are joined without hints: Spark broadcasts them
if it finds them small, and sorts and merges otherwise.

Rows: lower-cases A-Z; words are ``[^\\x20\\x09-\\x0D]+``; shingles have five words. An item of fewer
words has one shingle, its whole sequence, looked for at any place of a document. Items without
words, null texts, and rows without an id take no part. Repeated documents are reported once an id;
rows with the same item_id are one item of all their shingles. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.llm import common as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text; no empty ones."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def grams(w: str, n: int) -> str:
    """SQL: hashes of all n-word sequences of the word array ``w``, with n; none if it is shorter."""
    each = ", ".join(f"element_at({w}, i + {k})" for k in range(n))
    return f"transform(if(size({w}) >= {n}, sequence(1, size({w}) - {n - 1}), cast(array() as array<int>)), i -> xxhash64({n}, {each}))"


def leaks(
    docs: DataFrame, items: DataFrame, percent: int = 75, n: int = 5, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared): items of which a document holds at least ``percent`` of 100."""
    split = items.select(F.col(item_col).cast("long").alias("item_id"), words(F.col(item_text_col)).alias("w")).where("item_id is not null and size(w) > 0")
    short = " ".join(f"when size(w) = {k} then {grams('w', k)}" for k in range(1, n))
    shingles = split.select("item_id", F.explode(F.expr(f"case {short} else {grams('w', n)} end" if n > 1 else grams("w", 1))).alias("h")).distinct()
    sizes = shingles.groupBy("item_id").agg(F.count("*").alias("n_item_shingles"), F.sort_array(F.collect_list("h")).alias("hashes"))
    # the largest size in the class of size s is the power of two above it, less one
    upper = F.pow(F.lit(2), F.floor(F.log2("n_item_shingles")) + 1) - 1
    keep = F.floor(upper * (100 - percent) / 100).cast("int") + 1
    sized = C.materialize(sizes.withColumn("k", keep), "benchmark-items")
    sketches = sized.select("item_id", F.explode(F.slice("hashes", F.lit(1), F.col("k"))).alias("h"))
    all_shingles = sized.select("item_id", F.explode("hashes").alias("h"))
    # only lengths that occur among the items; n numbers at most
    lengths = sorted({n} | {r[0] for r in split.select(F.least(F.size("w"), F.lit(n))).distinct().collect()})

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")

    def exploded(df):
        w = df.select("doc_id", words(F.col("text")).alias("w"))
        parts = [F.expr(grams("w", k)) for k in lengths]
        return w.select("doc_id", F.explode(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("h"))

    found = exploded(source).join(sketches, "h").select("doc_id", "item_id").distinct()
    found = C.materialize(found, "benchmark-candidates")
    again = source.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    shared = exploded(again).join(all_shingles, "h").distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    verified = shared.join(found, ["doc_id", "item_id"], "left_semi").join(sized.select("item_id", "n_item_shingles"), "item_id")
    return verified.where(100 * F.col("n_shared") >= percent * F.col("n_item_shingles")).select("doc_id", "item_id", "n_item_shingles", "n_shared")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: which benchmark items stand in which documents."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
with item_words as (
  select item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from benchmark where text is not null),
item_grams as (
  select distinct item_id, unnest(case when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from item_words where len(w) > 0),
sizes as (select item_id, count(*) as n_item_shingles from item_grams group by item_id),
doc_words as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents where text is not null),
lengths as (select distinct least(5, len(w)) as n from item_words where len(w) > 0),
doc_grams as (
  select distinct doc_id, unnest(case when len(w) < n then [] else list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')) end) as s
  from doc_words cross join lengths)
select d.doc_id, i.item_id, s.n_item_shingles, count(*) as n_shared
from doc_grams d join item_grams i using (s) join sizes s using (item_id)
group by d.doc_id, i.item_id, s.n_item_shingles having 100 * count(*) >= 75 * s.n_item_shingles
"""
