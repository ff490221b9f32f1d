"""Peptide-like views over the driver's tables; one SQL text for Spark and DuckDB.

Sequences are the residue letters of a whole text, cut into consecutive pieces (``PIECES``): a row a piece, none for
a text without residue letters. ``[p]`` stands for them. Keys are the text's id times 2^24 plus the piece's number.
"""

from pyspark.sql import DataFrame, SparkSession

# view: table, columns kept, letters a piece
PIECES = {
    "samples": ("documents", "doc_id", "case when doc_id % 9 = 0 then 4 else 12 + length(text) % 25 end"),
    "amp": ("documents", "doc_id, n_chars", "12 + (length(text) + doc_id % 3) % 25"),
    "non_amp": ("benchmark", "item_id", "6 + item_id % 20"),
    "candidates": ("documents", "doc_id", "18"),
}
VIEWS = {
    "samples": """
select doc_id * 16777216 + n as sample_id, cast(doc_id % 8 as int) as config_id, pep,
  case when (doc_id + n) % 11 = 0 then '<nblank><SOS>' || pep || '<MASK><EOS><cblank>'
       when (doc_id + n) % 13 = 0 then '<nblank><SOS>' || pep
       when (doc_id + n) % 3 = 0 then '<nblank><SOS>' || pep || '<EOS><AMD>'
       else '<nblank><SOS>' || pep || '<EOS><cblank>' end as generated_sequence,
  case (doc_id + n) % 4 when 0 then 'True' when 1 then ' false' when 2 then '1' else 'TRUE ' end as flag_text
from [p] p
""",
    "amp": """
select doc_id * 16777216 + n as peptide_id,
  case (doc_id + n) % 6 when 0 then 'escherichia coli' when 1 then 'pseudomonas aeruginosa'
    when 2 then 'klebsiella pneumoniae' when 3 then 'staphylococcus aureus'
    when 4 then 'bacillus subtilis' else 'staphylococcus epidermidis' end as species,
  '<nblank><SOS>' || pep || case when (doc_id + n) % 3 = 0 then '<EOS><AMD>' else '<EOS><cblank>' end as modified_sequence,
  case (doc_id + n) % 5 when 0 then '[''GRAM-'']' when 1 then '[''GRAM+'', ''GRAM-'']' when 2 then '[''FUNGUS'']'
    when 3 then '[''MAMMALIAN CELL'', ''OTHER'']' else '[]' end as target_groups_text,
  case (doc_id + n) % 4 when 0 then '[''LIPID BILAYER'']' when 1 then '[''DNA / RNA'', ''OTHER'']'
    when 2 then '[''MEMBRANE PROTEIN'', ''CYTOPLASMIC PROTEIN'']' else '[]' end as target_objects_text,
  cast((n_chars + 31 * n) % 997 + 1 as double) / 7 + cast(doc_id as double) / 1000 as mic
from [p] p
""",
    "non_amp": """
select item_id * 16777216 + n as non_id, pep as sequence from [p] p
""",
    "candidates": """
select doc_id * 16777216 + cast(floor(n / 5) as bigint) as item_id, cast(n % 5 as int) as k,
  '<nblank><SOS>' || pep || '<EOS><cblank>' as candidate,
  cast(14 + (doc_id + cast(floor(n / 5) as bigint)) % 22 as int) as length
from [p] p
""",
    "grid_summary": """
select cast(g as int) as config_id, cast(floor(g / 64) as double) as species_scale,
  cast(floor(g / 8) % 8 as double) as groups_scale, cast(g % 8 as double) as mic_scale,
  mean_charge_score, mean_alpha_score, mean_beta_score, mean_boman_index, mean_gravy_score,
  success_rate, novelty_rate, repeat_rate
from (select l_orderkey % 512 as g,
        round(avg(l_discount) * 10, 9) as mean_charge_score, round(avg(l_tax), 9) as mean_alpha_score,
        round(avg(l_quantity) / 50, 9) as mean_beta_score, round(avg(l_extendedprice) / 10000, 9) as mean_boman_index,
        round(0.5 - avg(l_quantity) / 30, 9) as mean_gravy_score,
        round(avg(case when l_returnflag = 'N' then 100e0 else 0e0 end), 2) as success_rate,
        round(avg(case when l_linestatus = 'O' then 100e0 else 0e0 end), 2) as novelty_rate,
        round(avg(case when l_linenumber = 1 then 100e0 else 0e0 end), 2) as repeat_rate
      from {lineitem} group by l_orderkey % 512) s
""",
    "distances": """
select a.c_mktsegment as map_id, cast(a.c_nationkey as int) as i, cast(b.c_nationkey as int) as j,
  round(abs(a.v - b.v), 6) as d
from (select c_mktsegment, c_nationkey, avg(c_acctbal) as v from {customer} group by c_mktsegment, c_nationkey) a
join (select c_mktsegment, c_nationkey, avg(c_acctbal) as v from {customer} group by c_mktsegment, c_nationkey) b
  on a.c_mktsegment = b.c_mktsegment
""",
    "scores": """
select item_id, pass, pos, token_id, cast(doc_val as double) / 100 as score
from (select e.event_id as item_id, cast(p.r_regionkey as int) as pass, cast(t.n_nationkey % 5 as int) as pos,
        cast(floor(t.n_nationkey / 5) as int) as token_id,
        (e.user_id * 31 + p.r_regionkey * 17 + t.n_nationkey * 13 + e.event_id * 7) % 701 as doc_val
      from {events} e cross join {region} p cross join {nation} t where p.r_regionkey < 4) s
""",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _pieces(name: str, every: str, generate: str) -> str:
    """The view's pieces; ``every`` makes a replacement global, ``generate`` turns the array ``a`` into ``n`` and ``pep``."""
    table, keys, width = PIECES[name]
    letters = f"regexp_replace(text, '[^ACDEFGHIKLMNPQRSTVWYacfhiklnpqrstvwy]', ''{every})"
    return f"(select {keys}, {generate} from (select {keys}, regexp_extract_all({letters}, concat('.{{{{1,', {width}, '}}}}'), 0) as a from {{{table}}}) t)"


def _table(spark: SparkSession, path: str, spread: bool) -> DataFrame:
    """The table at ``path``; with ``spread``, one that is less than a full partition a core is dealt out over the
    cores first, as a small file is often a single row group, which is one task's. Larger tables aren't shuffled."""
    df, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    full = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    small = spread and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * full
    return df.repartition(cores) if small else df


def view(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """The view over ``sf_dir``, or over the tables given by name.

    A long text is cut in one pass, and only its id travels with the pieces.
    """
    # the outer form, since Spark infers filters from the inner one and computes the array again in each of them
    sql = VIEWS[name].replace("[p]", "(select * from " + _pieces(name, "", "posexplode_outer(a) as (n, pep)") + " o where n is not null)" if name in PIECES else "")
    return spark.sql(sql, **given, **{t: _table(spark, f"{sf_dir}/{t}.parquet", name in PIECES) for t in TABLES if "{" + t + "}" in sql and t not in given})


def oracle(*names: str) -> str:
    """The views as common table expressions for DuckDB."""
    cut = "generate_subscripts(a, 1) - 1 as n, unnest(a) as pep"
    each = {n: VIEWS[n].replace("[p]", _pieces(n, ", 'g'", cut) if n in PIECES else "").format(**{t: t for t in TABLES}) for n in names}
    return "with " + ",\n".join(f"{n} as ({sql})" for n, sql in each.items())
