"""The named queries of the library over the driver's tables, each with its SQL for DuckDB.

Arrays are returned as text, floats rounded to six decimals, so that both engines can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill import constants as K
from helixmill.adapters import VIEWS, oracle, view
from helixmill.functions import properties as P
from helixmill.functions import sequences as S
from helixmill.hashrand import uniform
from helixmill.operators import batching, composition, conditions, corruption, evaluation, membership, ranking, scores, vocabulary
from helixmill.session import scratch
from helixmill.sources import readers, writers

QUERIES, ORACLES = {}, {}
L, ALL = K.L_RESIDUES, K.L_RESIDUES + K.D_RESIDUES


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def r6(c):
    return F.round(c, 6)


def r9(c):
    """Scores that are short decimals often end in a five at the seventh place."""
    return F.round(c, 9)


def text(c):
    return F.array_join(c, ",")


# ---------------------------------------------------------------- SQL pieces

def u(seed, *keys) -> str:
    joined = " || ':' || ".join([f"'{seed}'", *[f"cast({k} as varchar)" for k in keys]])
    return f"(cast('0x' || substr(md5({joined}), 1, 8) as bigint) / 4294967296.0)"


def u4(seed, key, i) -> str:
    """Draw ``i`` of a row: the (i mod 4)-th 32 bits of the digest of block i div 4."""
    return f"(cast('0x' || substr(md5('{seed}:pos:' || cast({key} as varchar) || ':' || cast(({i}) // 4 as varchar)), cast(({i}) % 4 * 8 + 1 as bigint), 8) as bigint) / 4294967296.0)"


def h(seed, *keys) -> str:
    return "md5(" + " || ':' || ".join([f"'{seed}'", *[f"cast({k} as varchar)" for k in keys]]) + ")"


def payload(c: str) -> str:
    return f"case when regexp_matches({c}, '<SOS>[^\\n]*?<EOS>') then regexp_extract({c}, '<SOS>([^\\n]*?)<EOS>', 1) else trim({c}, ' \t\n\r') end"


def valid(c: str) -> str:
    return f"coalesce(regexp_matches({c}, '^[{ALL}]+$'), false)"


def tokens(c: str) -> str:
    return f"list_filter(regexp_extract_all({c}, '<[^>]*>|<[^>]*$|[^<>]'), lambda x: not (starts_with(x, '<') and not ends_with(x, '>')))"


def count_of(c: str, r: str) -> str:
    return f"(length({c}) - length(replace({c}, '{r}', '')))"


def mean_of(c: str, scale: dict) -> str:
    return f"(case when {c} is null or {c} = '' then 0 else (" + " + ".join(f"{count_of(c, r)} * ({v}e0)" for r, v in scale.items()) + f") / length({c}) end)"


def charge_score(c: str) -> str:
    q = f"({count_of(c, 'K')} + {count_of(c, 'R')} - {count_of(c, 'D')} - {count_of(c, 'E')} - 4.5)"
    return f"(case when {c} is null or {c} = '' then 0 else exp(-power({q}, 2) / 8.0) end)"


def moment(c: str, angle: int, need: bool = False) -> str:
    value = "case substr({c}, i, 1) " + " ".join(f"when '{r}' then {v}e0" for r, v in K.EISENBERG.items()) + " else 0 end"
    value = value.replace("{c}", c)
    total = lambda f: f"coalesce(list_sum(list_transform(range(1, length({c}) + 1), lambda i: ({value}) * {f}(radians({angle}) * i))), 0)"
    none = f"{c} is null or {c} = ''" + (f" or {count_of(c, 'C')} < 2" if need else "")
    return f"(case when {none} then 0 else sqrt(power({total('cos')}, 2) + power({total('sin')}, 2)) / length({c}) end)"


def charge7(c: str) -> str:
    pos = lambda pk: f"(power(10.0, ({pk}) - 7.0) / (1 + power(10.0, ({pk}) - 7.0)))"
    neg = lambda pk: f"(power(10.0, 7.0 - ({pk})) / (1 + power(10.0, 7.0 - ({pk}))))"
    case = lambda e, d, t: f"case {e} " + " ".join(f"when '{r}' then {v}" for r, v in t.items()) + f" else {d} end"
    parts = [pos(case(f"left({c}, 1)", K.PK_N_TERM, K.PK_N_TERM_BY_RESIDUE)), "-" + neg(case(f"right({c}, 1)", K.PK_C_TERM, K.PK_C_TERM_BY_RESIDUE))]
    parts += [f"{count_of(c, r)} * {pos(v)}" for r, v in K.PK_BASE.items()] + [f"-{count_of(c, r)} * {neg(v)}" for r, v in K.PK_ACID.items()]
    return f"(case when {c} is not null and {c} <> '' then " + " + ".join(parts) + " end)"


def diversity_sql(c: str) -> str:
    return f"(len(list_distinct(string_split({c}, ''))) - 0.1 * ({count_of(c, 'K')} + {count_of(c, 'R')} + {count_of(c, 'L')}))"


def clean_sql(c: str) -> str:
    return f"regexp_replace(upper(trim({c})), '[^{L}]', '', 'g')"


JUDGED = (
    oracle("samples", "amp", "non_amp")
    + f""", training as (select distinct p as payload from (select {payload('modified_sequence')} as p from amp union all select {payload('sequence')} from non_amp) x where {valid('p')}),
s1 as (select *, {payload('generated_sequence')} as payload from samples), s2 as (select *, {valid('payload')} as is_valid from s1),
s3 as (select s2.*, is_valid and t.payload is not null as known from s2 left join training t on t.payload = s2.payload),
judged as (select *, is_valid and row_number() over (partition by config_id, payload, is_valid order by sample_id) > 1 as is_repeat from s3)"""
)


def training(spark, d) -> DataFrame:
    return batching.training_set(view(spark, d, "amp").select("modified_sequence"), view(spark, d, "non_amp").select("sequence"))


def judged(spark, d) -> DataFrame:
    return evaluation.judged(view(spark, d, "samples"), training(spark, d))


def flagged(spark, d) -> DataFrame:
    return evaluation.flagged(view(spark, d, "samples"), training(spark, d))


def by_payload(spark, d) -> DataFrame:
    return evaluation.by_payload(view(spark, d, "samples"), training(spark, d))


# ---------------------------------------------------------------- sequences

@query("frame_sequence", oracle("non_amp") + " select non_id, '<nblank><SOS>' || sequence || '<EOS><cblank>' as framed from non_amp")
def _(spark, d):
    return view(spark, d, "non_amp").select("non_id", S.frame(F.col("sequence")).alias("framed"))


@query("raw_sequence", oracle("amp") + " select peptide_id, string_split(string_split(substr(modified_sequence, 9), '>')[2], '<')[1] as raw_sequence from amp")
def _(spark, d):
    return view(spark, d, "amp").select("peptide_id", S.raw_sequence(F.expr("substr(modified_sequence, 9)")).alias("raw_sequence"))


@query("tokenize", oracle("samples") + f" select sample_id, len(t) as n_tokens, array_to_string(t, ' ') as tokens from (select sample_id, {tokens('generated_sequence')} as t from samples) x")
def _(spark, d):
    t = view(spark, d, "samples").select("sample_id", S.tokenize(F.col("generated_sequence")).alias("t"))
    return t.select("sample_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query("extract_payload", oracle("samples") + f" select sample_id, {payload('generated_sequence')} as payload from samples")
def _(spark, d):
    return view(spark, d, "samples").select("sample_id", S.extract_payload(F.col("generated_sequence")).alias("payload"))


@query("valid_filter", oracle("samples") + f" select sample_id, payload from (select sample_id, {payload('generated_sequence')} as payload from samples) x where {valid('payload')}")
def _(spark, d):
    s = view(spark, d, "samples").select("sample_id", S.extract_payload(F.col("generated_sequence")).alias("payload"))
    return s.where(S.is_valid(F.col("payload")))


@query("residue_slice", oracle("samples") + """, p as (select sample_id, generated_sequence as g, instr(generated_sequence, '>') as a from samples),
q as (select *, case when a > 0 and instr(substr(g, a + 1), '>') > 0 then a + instr(substr(g, a + 1), '>') else 0 end as b from p)
select sample_id, case when b > 0 and instr(substr(g, b + 1), '<') > 0 then substr(g, b + 1, instr(substr(g, b + 1), '<') - 1) else regexp_replace(g, '<[^>]+>', '', 'g') end as residues from q""")
def _(spark, d):
    return view(spark, d, "samples").select("sample_id", S.residue_slice(F.col("generated_sequence")).alias("residues"))


@query("clean_residues", oracle("samples") + f" select sample_id, r as residues from (select sample_id, {clean_sql('pep')} as r from samples) x where r <> ''")
def _(spark, d):
    return view(spark, d, "samples").select("sample_id", S.clean_residues(F.col("pep")).alias("residues")).where("residues <> ''")


@query("occurrences", oracle("samples") + """ select sample_id, array_to_string(list_transform(range(1, len(p)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + 5 * (i - 1)), ',') as positions
from (select sample_id, string_split(generated_sequence, '<EOS>') as p from samples) x""")
def _(spark, d):
    return view(spark, d, "samples").select("sample_id", text(S.occurrences(F.col("generated_sequence"), "<EOS>")).alias("positions"))


@query("crop_terminus", oracle("samples") + """ select sample_id, case when i < 0 then g when starts_with(substr(g, i + 6), '<AMD>') and i + 10 < 40 then substr(g, 1, i + 10)
  when starts_with(substr(g, i + 6), '<cblank>') and i + 13 < 40 then substr(g, 1, i + 13) else substr(g, 1, i + 5) end as cropped
from (select sample_id, generated_sequence as g, instr(generated_sequence, '<EOS>') - 1 as i from samples) x""")
def _(spark, d):
    return view(spark, d, "samples").select("sample_id", S.crop_terminus(F.col("generated_sequence"), F.lit(40)).alias("cropped"))


@query("parse_flag", oracle("samples") + " select sample_id, lower(trim(flag_text)) = 'true' as strict, lower(trim(flag_text)) in ('true', '1') as lenient from samples")
def _(spark, d):
    f = F.col("flag_text")
    return view(spark, d, "samples").select("sample_id", S.parse_flag(f).alias("strict"), S.parse_flag(f, ("true", "1")).alias("lenient"))


# ---------------------------------------------------------------- vocabulary

def vocab_sql(c: str, of: str) -> str:
    return f"""(with t as (select distinct unnest({tokens(c)}) as token from {of}), r as (select token, row_number() over (order by token) as token_id from t where token not in ('<blank>', '<MASK>'))
select token, cast(token_id as integer) as token_id from r union all select '<blank>', 0 union all select '<MASK>', cast((select count(*) from r) + 1 as integer))"""


@query("vocab", oracle("amp") + f" select * from {vocab_sql('modified_sequence', 'amp')} v")
def _(spark, d):
    return vocabulary.build_vocab(view(spark, d, "amp"), "modified_sequence")


@query("vocab_resolve", oracle("amp", "non_amp") + f""", fresh as (select * from {vocab_sql('modified_sequence', 'amp')} v), saved as (select * from {vocab_sql('sequence', 'non_amp')} w)
select * from saved where not exists (select 1 from fresh where token not in (select token from saved))
union all select * from fresh where exists (select 1 from fresh where token not in (select token from saved))""")
def _(spark, d):
    return vocabulary.resolve_vocab(vocabulary.build_vocab(view(spark, d, "amp"), "modified_sequence"), vocabulary.build_vocab(view(spark, d, "non_amp"), "sequence"))


ENCODED = oracle("amp") + f""", vocab as (select * from {vocab_sql('modified_sequence', 'amp')} v), m as (select map_from_entries(list((token, token_id))) as m from vocab),
enc as (select peptide_id, list_transform(range(1, 69), lambda i: case when i <= len(t) then m[t[i]] else 0 end) as ids, len(t) as n from (select peptide_id, {tokens('modified_sequence')} as t from amp) x cross join m)"""


def encoded(spark, d) -> DataFrame:
    amp = view(spark, d, "amp").select("peptide_id", "modified_sequence")
    return vocabulary.encode(amp, vocabulary.build_vocab(amp, "modified_sequence"), "modified_sequence")


@query("encode_ids", ENCODED + " select peptide_id, array_to_string(ids, ',') as ids from enc")
def _(spark, d):
    return encoded(spark, d).select("peptide_id", text("ids").alias("ids"))


@query("one_hot_long", ENCODED + " select peptide_id, unnest(range(0, 68)) as pos, unnest(ids) as token_id from enc")
def _(spark, d):
    return vocabulary.one_hot_long(encoded(spark, d), "peptide_id").select("peptide_id", F.col("pos").cast("long").alias("pos"), "token_id")


@query("decode_ids", ENCODED + ", w as (select map_from_entries(list((token_id, token))) as w from vocab) select peptide_id, array_to_string(list_transform(ids[1:n], lambda x: w[x]), '') as decoded from enc cross join w")
def _(spark, d):
    e = encoded(spark, d).withColumn("n", vocabulary.effective_length(F.col("ids")))
    return vocabulary.decode_ids(e, vocabulary.build_vocab(view(spark, d, "amp"), "modified_sequence"), "n").select("peptide_id", "decoded")


@query("effective_length", ENCODED + " select peptide_id, len(list_filter(ids, lambda x: x <> 0)) as n from enc")
def _(spark, d):
    return encoded(spark, d).select("peptide_id", vocabulary.effective_length(F.col("ids")).cast("long").alias("n"))


@query("decode_argmax", oracle("scores") + """, b as (select item_id, pos, token_id, row_number() over (partition by item_id, pos order by score desc, token_id) as r from scores where pass = 0)
select item_id, string_agg(chr(65 + token_id), '' order by pos) as decoded from b where r = 1 group by item_id""")
def _(spark, d):
    s = view(spark, d, "scores").where("pass = 0")
    names = s.select("token_id").distinct().withColumn("token", F.chr(65 + F.col("token_id")))
    return vocabulary.decode_argmax(s, names)


# ---------------------------------------------------------------- conditions

EDGES = oracle("amp") + ", e as (select quantile_cont(mic, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) as edges from amp), binned as (select amp.*, edges, cast(greatest(len(list_filter(edges, lambda x: x < mic)) - 1, 0) as integer) as bin from amp cross join e)"


def _hot(values: str, names: list[str]) -> str:
    return "[" + ", ".join(f"cast(list_contains({values}, '{n}') as integer)" for n in names) + "]"


def _listed(c: str) -> str:
    return f"string_split(replace(replace(replace({c}, '[', ''), ']', ''), '''', ''), ', ')"


CONDITIONS = EDGES + ", cond as (select *, list_concat(" + _hot("[species]", K.SPECIES) + ", list_concat(" + _hot(_listed("target_groups_text"), K.GROUPS) + ", list_concat(" + _hot(_listed("target_objects_text"), K.OBJECTS) + ", list_transform(range(0, 10), lambda i: cast(i = bin as integer))))) as c from binned)"


def binned(spark, d) -> DataFrame:
    return conditions.quantile_bin(view(spark, d, "amp"), "mic")


@query("decile_bins", EDGES + " select peptide_id, bin from binned")
def _(spark, d):
    return binned(spark, d).select("peptide_id", "bin")


@query("condition_vector", CONDITIONS + " select peptide_id, array_to_string(c, ',') as condition from cond")
def _(spark, d):
    c = conditions.condition_vector(binned(spark, d))
    return c.select("peptide_id", text(F.col("condition").cast("array<int>")).alias("condition"))


@query("decode_conditions", CONDITIONS + f""" select peptide_id, species, array_to_string(list_filter({K.GROUPS}, lambda g: list_contains({_listed('target_groups_text')}, g)), ',') as groups,
array_to_string(list_filter({K.OBJECTS}, lambda g: list_contains({_listed('target_objects_text')}, g)), ',') as objects,
round(case bin when 0 then 0 when 9 then edges[10] else edges[bin] end, 6) as mic_low, round(case bin when 9 then 5 * edges[10] else edges[bin + 1] end, 6) as mic_high from cond""")
def _(spark, d):
    c = conditions.condition_vector(binned(spark, d)).select("peptide_id", "condition", "edges")
    out = conditions.decode_conditions(c, F.col("edges"))
    return out.select("peptide_id", "species", text("groups").alias("groups"), text("objects").alias("objects"), r6("mic_low").alias("mic_low"), r6("mic_high").alias("mic_high"))


@query("log_zscore", oracle("amp") + """, s as (select avg(ln(mic + 1e-6)) as m, stddev_samp(ln(mic + 1e-6)) as sd, min(ln(mic + 1e-6)) as lo, max(ln(mic + 1e-6)) as hi from amp)
select peptide_id, round((ln(mic + 1e-6) - m) / sd, 6) as norm, round(m, 6) as mean, round(sd, 6) as std, round((lo - m) / sd, 6) as norm_min, round((hi - m) / sd, 6) as norm_max from amp cross join s""")
def _(spark, d):
    return conditions.log_zscore(view(spark, d, "amp"), "mic").select("peptide_id", *[r6(c).alias(c) for c in ("norm", "mean", "std", "norm_min", "norm_max")])


@query("upper_triangle", oracle("distances") + " select map_id, i, j, d from distances where i < j")
def _(spark, d):
    return conditions.upper_triangle(view(spark, d, "distances")).select("map_id", "i", "j", "d")


@query("distance_dictionary", oracle("distances") + """, q as (select quantile_cont(d, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) as e from distances where i < j),
e as (select list_concat([0.0], list_sort(list_distinct(e))) as e from q)
select cast(i - 1 as integer) as bin_id, round(e[i], 6) as edge from (select e, unnest(range(1, len(e) + 1)) as i from e) x""")
def _(spark, d):
    return conditions.distance_dictionary(view(spark, d, "distances")).select("bin_id", r6("edge").alias("edge"))


@query("distance_bins", oracle("distances") + """, q as (select quantile_cont(d, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) as e from distances where i < j),
e as (select list_concat([0.0], list_sort(list_distinct(e))) as e from q)
select cast(i - 1 as integer) as bin_id, round(e[i], 6) as edge, null as special from (select e, unnest(range(1, len(e))) as i from e) x
union all select cast(len(e) - 1 + k as integer), null, ['MASK', 'blank', 'SOS', 'EOS'][k + 1] from (select e, unnest(range(0, 4)) as k from e) y""")
def _(spark, d):
    return conditions.distance_bins(view(spark, d, "distances")).select("bin_id", r6("edge").alias("edge"), "special")


@query("negative_condition", oracle("non_amp") + " select non_id, '0,0,0,1,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,1,0,0' as condition from non_amp")
def _(spark, d):
    return conditions.negative_condition(view(spark, d, "non_amp")).select("non_id", text(F.col("condition").cast("array<int>")).alias("condition"))


@query("spec_vector", oracle("amp") + " select peptide_id, array_to_string(list_transform(range(0, 5), lambda i: cast(list_contains([peptide_id % 5, peptide_id % 3], i) as integer)), ',') as spec from amp")
def _(spark, d):
    spec = F.expr("array(cast(peptide_id % 5 as int), cast(peptide_id % 3 as int))")
    return view(spark, d, "amp").select("peptide_id", text(conditions.spec_vector(spec, 5).cast("array<int>")).alias("spec"))


# ---------------------------------------------------------------- batches

def _pos_neg(spark, d):
    pos = view(spark, d, "amp").select(F.col("peptide_id").alias("id"), F.col("modified_sequence").alias("sequence"))
    neg = view(spark, d, "non_amp").select(F.col("non_id").alias("id"), S.frame(F.col("sequence")).alias("sequence"))
    return pos, neg


@query("labelled_union", oracle("amp", "non_amp") + " select 1 as label, peptide_id as id, modified_sequence as sequence from amp union all select 0, non_id, '<nblank><SOS>' || sequence || '<EOS><cblank>' from non_amp")
def _(spark, d):
    return batching.labelled_union(*_pos_neg(spark, d))


@query("balanced_batches", oracle("amp", "non_amp") + f""", p as (select peptide_id as id, row_number() over (order by {h('7:0:pos', 'peptide_id')}, peptide_id) - 1 as r from amp),
k as (select (select count(*) from amp) // 4 as b, (select count(*) from non_amp) // 4 as cap), cy as (select unnest(range(0, cast(ceil(b * 1.0 / cap) as bigint))) as cycle from k),
n as (select non_id as id, cycle, row_number() over (partition by cycle order by {h('7:0:neg', 'cycle', 'non_id')}, non_id) - 1 as r from non_amp cross join cy)
select r // 4 as batch, 1 as label, id from p, k where r // 4 < b union all select cycle * cap + r // 4, 0, id from n, k where r // 4 < cap and cycle * cap + r // 4 < b""")
def _(spark, d):
    return batching.balanced_batches(*_pos_neg(spark, d), size=8, ratio=0.5, seed=7)


@query("shuffled_batches", oracle("amp") + f" select peptide_id as id, (row_number() over (order by {h('11', 'peptide_id')}, peptide_id) - 1) // 64 as batch from amp")
def _(spark, d):
    return batching.shuffled_batches(_pos_neg(spark, d)[0], 64, 11)


@query("training_set", JUDGED + " select payload from training")
def _(spark, d):
    return training(spark, d)


@query("param_grid", oracle("grid_summary") + " select a.species_scale, b.groups_scale, c.mic_scale from (select distinct species_scale from grid_summary) a cross join (select distinct groups_scale from grid_summary) b cross join (select distinct mic_scale from grid_summary) c")
def _(spark, d):
    g = view(spark, d, "grid_summary")
    return batching.param_grid(**{c: g.select(c) for c in ("species_scale", "groups_scale", "mic_scale")})


@query("request_plan", oracle("samples") + f""" select sample_id, (row_number() over (order by {h('5:order', 'sample_id')}, sample_id) - 1) // 256 as batch,
cast(floor({u('5', "'mic'", 'sample_id')} * 3) + 2 as integer) as mic_bin, cast(floor({u('5', "'length'", 'sample_id')} * 22) + 14 as integer) as length from samples""")
def _(spark, d):
    return batching.request_plan(view(spark, d, "samples"), "sample_id", 256, 3, 5)


# ---------------------------------------------------------------- corruption

@query("mask_tokens", ENCODED + f", k as (select peptide_id, ids, {u('3', chr(39) + 't' + chr(39), 'peptide_id')} as t from enc) select peptide_id, round(t, 6) as t, array_to_string(list_transform(range(1, 69), lambda i: case when ids[i] <> 0 and {u4('3', 'peptide_id', 'i - 1')} < 1 - t then 48 else ids[i] end), ',') as masked from k")
def _(spark, d):
    m = corruption.mask_tokens(encoded(spark, d), 48, 0, 3, "peptide_id")
    return m.select("peptide_id", r6("t").alias("t"), text("masked").alias("masked"))


@query("mask_loglinear", ENCODED + f""", k as (select peptide_id, ids, {u('4', "'t'", 'peptide_id')} as t from enc)
select peptide_id, round(-ln(1 - 0.999 * t), 6) as sigma, round(0.999 / (1 - 0.999 * t), 6) as rate,
array_to_string(list_transform(range(1, 69), lambda i: case when {u4('4', 'peptide_id', 'i - 1')} < 1 - exp(-(-ln(1 - 0.999 * t))) then 48 else ids[i] end), ',') as masked from k""")
def _(spark, d):
    m = corruption.mask_loglinear(encoded(spark, d), 48, 4, "peptide_id")
    return m.select("peptide_id", r6("sigma").alias("sigma"), r6("rate").alias("rate"), text("masked").alias("masked"))


@query("stratified_t", oracle("samples") + f" select sample_id, round(fmod({u('6', 'sample_id')} / count(*) over (partition by config_id) + (row_number() over (partition by config_id order by sample_id) - 1) * 1.0 / count(*) over (partition by config_id), 1) * 0.999 + 0.001, 6) as t from samples")
def _(spark, d):
    return corruption.stratified_t(view(spark, d, "samples"), "config_id", "sample_id", 6).select("sample_id", r6("t").alias("t"))


@query("condition_dropout", oracle("samples") + " select sample_id, " + ", ".join(f"{u('8', chr(39) + c + chr(39), 'sample_id')} < 0.1 as drop_{c}" for c in ("species", "groups", "mic")) + " from samples")
def _(spark, d):
    return corruption.condition_dropout(view(spark, d, "samples"), 0.1, 8, "sample_id").select("sample_id", "drop_species", "drop_groups", "drop_mic")


def _positions(spark, d) -> DataFrame:
    """Every position once, without a shuffle: all have the first token of the first pass."""
    return view(spark, d, "scores").where("pass = 0 and token_id = 0").select("item_id", "pos")


@query("masked_nll", oracle("scores") + f""", t as (select distinct item_id, pos, cast((item_id + pos) % 4 as integer) as target, {u('9', 'item_id', 'pos')} < 0.5 as m from scores),
x as (select item_id, pos, target, max(score) as top from scores join t using (item_id, pos) where pass = 0 and token_id not in (4, 0) and m and target <> 0 group by all),
z as (select item_id, pos, any_value(top) + ln(sum(exp(score - top))) - max(case when token_id = target then score end) as loss from scores join x using (item_id, pos) where pass = 0 and token_id not in (4, 0) group by item_id, pos)
select round(coalesce(avg(loss), 0), 6) as nll, count(loss) as n_positions from z""")
def _(spark, d):
    s = view(spark, d, "scores").where("pass = 0")
    t = _positions(spark, d).withColumns({"target": F.expr("cast((item_id + pos) % 4 as int)"), "is_masked": uniform(9, "item_id", "pos") < 0.5})
    return corruption.masked_nll(s, t, [4, 0], 0).select(r6("nll").alias("nll"), "n_positions")


@query("position_nll", oracle("scores") + """, t as (select distinct item_id, pos, cast((item_id + pos) % 4 as integer) as target from scores),
x as (select item_id, pos, any_value(target) as target, max(score) as top from scores join t using (item_id, pos) where pass = 0 and token_id <> 4 group by item_id, pos),
z as (select item_id, pos, any_value(top) + ln(sum(exp(score - top))) - max(case when token_id = target then score end) as loss from scores join x using (item_id, pos) where pass = 0 and token_id <> 4 group by item_id, pos)
select round(avg(loss), 6) as nll, round(1.5 * avg(loss), 6) as total, count(loss) as n_positions from z""")
def _(spark, d):
    s = view(spark, d, "scores").where("pass = 0")
    t = _positions(spark, d).withColumn("target", F.expr("cast((item_id + pos) % 4 as int)"))
    return corruption.position_nll(s, t, 4).select(r6("nll").alias("nll"), r6("total").alias("total"), "n_positions")


# ---------------------------------------------------------------- evaluation

@query("novelty_flag", JUDGED + " select sample_id, known from judged")
def _(spark, d):
    return flagged(spark, d).select("sample_id", "known")


@query("novelty_by_sketch", JUDGED + " select sample_id, known from judged")
def _(spark, d):
    """The same answers, with payloads that a written sketch of both corpora rules out kept from the join."""
    corpora = [batching.training_set(view(spark, d, "amp").select("modified_sequence"), None), batching.training_set(None, view(spark, d, "non_amp").select("sequence"))]
    path = scratch(spark, "sketch")
    shape = membership.shape_for(1 << 20)  # the keys it is planned for
    for i, corpus in enumerate(corpora):  # the second is added to what the first has written
        new = membership.build(corpus, "payload", shape)
        membership.save(membership.merge(membership.load(spark, f"{path}/{i - 1}"), new) if i else new, f"{path}/{i}")
    sketch = membership.load(spark, f"{path}/{len(corpora) - 1}")
    return evaluation.flagged(view(spark, d, "samples"), training(spark, d), sketch).select("sample_id", "known")


@query("novel_rows", JUDGED + " select sample_id, payload from s1 where payload not in (select payload from training)")
def _(spark, d):
    s = view(spark, d, "samples").withColumn("payload", S.extract_payload(F.col("generated_sequence")))
    return evaluation.novel(s, training(spark, d)).select("sample_id", "payload")


@query("known_rows", JUDGED + " select sample_id, payload from s1 where payload in (select payload from training)")
def _(spark, d):
    s = view(spark, d, "samples").withColumn("payload", S.extract_payload(F.col("generated_sequence")))
    return evaluation.known(s, training(spark, d)).select("sample_id", "payload")


@query("valid_novel", JUDGED + " select sample_id, payload from judged where is_valid and not known")
def _(spark, d):
    return flagged(spark, d).where("is_valid and not known").select("sample_id", "payload")


@query("repeat_flag", JUDGED + " select sample_id, is_repeat from judged")
def _(spark, d):
    return judged(spark, d).select("sample_id", "is_repeat")


RATES = """ select config_id, total_samples, valid_count, novel_count, unique_count, valid_count - unique_count as repeat_count,
coalesce(round(100.0 * valid_count / nullif(total_samples, 0), 2), 0) as success_rate, coalesce(round(100.0 * novel_count / nullif(total_samples, 0), 2), 0) as novelty_rate,
[x]coalesce(round(100.0 * (valid_count - unique_count) / nullif(valid_count, 0), 2), 0) as repeat_rate
from (select config_id, count(*) as total_samples, count(*) filter (is_valid) as valid_count, count(*) filter (is_valid and not known) as novel_count, count(*) filter (is_valid and not is_repeat) as unique_count from judged group by config_id) x"""


@query("run_rates", JUDGED + RATES.replace("[x]", "coalesce(round(100.0 * novel_count / nullif(valid_count, 0), 2), 0) as novelty_of_valid, "))
def _(spark, d):
    return evaluation.run_rates(by_payload(spark, d))


@query("summary_row", JUDGED + f""", g as (select config_id, species_scale, groups_scale, mic_scale from ({VIEWS['grid_summary'].format(lineitem='lineitem')}) q), r as ({RATES.replace("[x]", "")})
select config_id, species_scale, groups_scale, mic_scale, coalesce(valid_count, 0) as valid_count, coalesce(novel_count, 0) as novel_count, coalesce(repeat_count, 0) as repeat_count,
coalesce(total_samples, 0) as total_samples, printf('%.2f', coalesce(success_rate, 0)) as success_rate,
printf('%.2f', coalesce(novelty_rate, 0)) as novelty_rate, printf('%.2f', coalesce(repeat_rate, 0)) as repeat_rate, 'run-' || g.config_id || '.csv' as output_file from r full join g using (config_id)""")
def _(spark, d):
    settings = view(spark, d, "grid_summary").withColumn("output_file", F.format_string("run-%d.csv", "config_id"))
    return evaluation.summary_row(evaluation.run_rates(by_payload(spark, d)), settings)


@query("summary_log", ORACLES["summary_row"])
def _(spark, d):
    """The summary table by way of its log: a first version of all runs, a second of the even ones, and a compaction between reads."""
    path = scratch(spark, "summary")
    rows = QUERIES["summary_row"](spark, d)
    # a row a run, written once: each append and each half of the first would go over all samples again
    written = scratch(spark, "summary-rows")
    rows.write.parquet(written)
    rows = spark.read.schema(rows.schema).parquet(written)
    stale = rows.withColumns({"valid_count": F.col("valid_count") - 1, "success_rate": F.lit("stale")})
    writers.append_summary(stale.where("config_id % 2 = 0").unionByName(rows.where("config_id % 2 = 1")), path)
    writers.append_summary(rows.where("config_id % 2 = 0"), path)
    writers.compact_summary(spark, path)
    return readers.read_summary(spark, path)


@query("stream_run_rates", JUDGED + RATES.replace("[x]", ""))
def _(spark, d):
    from helixmill.streaming.run_rates import stream_run_rates

    path = f"{d}/documents.parquet"
    docs = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # one file or a folder of them
    return stream_run_rates(spark, view(spark, d, "samples", documents=docs), training(spark, d))


SCORES = {"charge_score": charge_score, "alpha_score": lambda c: moment(c, 100), "beta_score": lambda c: moment(c, 160, True), "boman_index": lambda c: mean_of(c, K.BOMAN), "gravy_score": lambda c: mean_of(c, K.KYTE_DOOLITTLE)}
SCORED = JUDGED + ", up as (select *, upper(payload) as s, is_valid and not known as scored from judged), scored as (select sample_id, config_id, scored, " + ", ".join(f"case when scored then {f('s')} else 0 end as {n}" for n, f in SCORES.items()) + " from up)"


@query("score_samples", SCORED + " select sample_id, scored, " + ", ".join(f"round({n}, 9) as {n}" for n in SCORES) + " from scored")
def _(spark, d):
    return evaluation.score_samples(flagged(spark, d)).select("sample_id", "scored", *[r9(n).alias(n) for n in SCORES])


@query("run_property_means", SCORED + " select r.config_id, " + ", ".join(f"round(avg(case when scored then {n} end), 9) as mean_{n}" for n in SCORES) + " from (select distinct config_id from samples union select distinct cast(l_linenumber as integer) from lineitem) r left join scored s using (config_id) group by r.config_id")
def _(spark, d):
    runs = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_linenumber").cast("int").alias("config_id"))
    m = evaluation.run_property_means(evaluation.score_samples(by_payload(spark, d)), runs)
    return m.select("config_id", *[r9(f"mean_{n}").alias(f"mean_{n}") for n in SCORES])


@query("run_files", SCORED + " select config_id, " + ", ".join(f"round(avg(case when scored then {n} end), 9) as mean_{n}" for n in SCORES) + " from scored group by config_id")
def _(spark, d):
    """Each run's samples as a folder of files, and the mean scores of the folders that the summary names.

    Rebalanced by run, so that a large run is several tasks' and files, and a small one is one.
    """
    path, s = scratch(spark, "runs"), flagged(spark, d)
    columns = [F.col("generated_sequence"), F.col("payload"), *[F.initcap(F.col(c).cast("string")) for c in ("is_valid", "known")], F.lit("False")]
    rows = s.select("config_id", *[c.alias(n) for c, n in zip(columns, readers.SAMPLE_COLUMNS)])
    rows.hint("rebalance", "config_id").write.partitionBy("config_id").option("header", True).csv(path)
    summary = spark.read.option("header", True).csv(path).select("config_id", F.regexp_replace(F.input_file_name(), "/[^/]*$", "").alias("output_file")).distinct()
    m = evaluation.attach_runs(summary, readers.read_runs(spark, summary))
    return m.select("config_id", *[r9(f"mean_{n}").alias(f"mean_{n}") for n in SCORES])


def _property(name: str, column, sql) -> None:
    @query(name, oracle("samples") + f" select sample_id, round({sql('s')}, 9) as {name} from (select sample_id, upper(pep) as s from samples) x")
    def _(spark, d):
        return view(spark, d, "samples").select("sample_id", r9(column(F.upper("pep"))).alias(name))


_property("charge_score", P.charge_score, charge_score)
_property("hmoment_alpha", lambda c: P.hmoment(c, 100), lambda c: moment(c, 100))
_property("hmoment_beta", lambda c: P.hmoment(c, 160, True), lambda c: moment(c, 160, True))
_property("boman_index", P.boman, SCORES["boman_index"])
_property("gravy", P.gravy, SCORES["gravy_score"])
_property("charge_ph7", P.charge_at_ph, charge7)
_property("diversity", P.diversity, diversity_sql)


@query("charge_summary", oracle("samples", "non_amp") + f""", x as (select 'samples' as source, {clean_sql('pep')} as r from samples union all select 'negatives', {clean_sql('sequence')} from non_amp)
select source, count(*) as n, round(avg({charge7('r')}), 6) as mean_charge, round(var_pop({charge7('r')}), 6) as var_charge from x where r <> '' group by source""")
def _(spark, d):
    a = view(spark, d, "samples").select(F.lit("samples").alias("source"), S.clean_residues(F.col("pep")).alias("residues"))
    b = view(spark, d, "non_amp").select(F.lit("negatives").alias("source"), S.clean_residues(F.col("sequence")).alias("residues"))
    out = composition.charge_summary(a.unionByName(b), ["samples", "negatives"])
    return out.select("source", "n", r6("mean_charge").alias("mean_charge"), r6("var_charge").alias("var_charge"))


PAYLOADS = JUDGED + f", tp as (select p from (select {payload('modified_sequence')} as p from amp union all select {payload('sequence')} from non_amp) x where {valid('p')}), letters as (select unnest(string_split('{ALL}', '')) as residue)"


def _lists(spark, d):
    amp, neg = view(spark, d, "amp").select("modified_sequence"), view(spark, d, "non_amp").select("sequence")
    return batching.training_list(amp.union(neg), "modified_sequence"), batching.load_for_frequency(view(spark, d, "samples"), "generated_sequence", flag="flag_text")


SAMPLED = "sp as (select payload as p from s2 where is_valid and lower(trim(flag_text)) in ('true', '1'))"


@query("training_list", PAYLOADS + " select p as payload, count(*) as n from tp group by p")
def _(spark, d):
    return _lists(spark, d)[0].groupBy("payload").agg(F.count("*").alias("n"))


@query("frequency_list", PAYLOADS + f""", {SAMPLED}, al as (select payload as p from s2 where is_valid)
select p as payload, max(a) as n_all, max(v) as n_flagged from (select p, count(*) as a, 0 as v from al group by p union all select p, 0, count(*) from sp group by p) x group by p""")
def _(spark, d):
    s = view(spark, d, "samples")
    rows = [batching.load_for_frequency(s, "generated_sequence", only, "flag_text").withColumn("only", F.lit(only)) for only in (False, True)]
    return rows[0].unionByName(rows[1]).groupBy("payload").agg(F.count_if(~F.col("only")).alias("n_all"), F.count_if("only").alias("n_flagged"))


@query("aa_frequency", PAYLOADS + f""", {SAMPLED}, a as (select unnest(string_split(p, '')) as residue from tp), b as (select unnest(string_split(p, '')) as residue from sp),
x as (select residue, (select count(*) from a where a.residue = l.residue) as training_count, (select count(*) from b where b.residue = l.residue) as sampled_count from letters l)
select residue, case when residue = upper(residue) then 'L' else 'D' end as type, training_count, round(100.0 * training_count / (select count(*) from a), 6) as training_frequency,
sampled_count, round(100.0 * sampled_count / (select count(*) from b), 6) as sampled_frequency from x""")
def _(spark, d):
    out = composition.aa_frequency(*_lists(spark, d))
    return out.select("residue", "type", "training_count", r6("training_frequency").alias("training_frequency"), "sampled_count", r6("sampled_frequency").alias("sampled_frequency"))


@query("chirality_totals", PAYLOADS + f""", {SAMPLED}, x as (select 'training' as corpus, unnest(string_split(p, '')) as residue from tp union all select 'samples', unnest(string_split(p, '')) from sp)
select corpus, case when residue = upper(residue) then 'L' else 'D' end as type, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (partition by corpus), 6) as share from x group by 1, 2""")
def _(spark, d):
    train, samples = _lists(spark, d)
    both = train.withColumn("corpus", F.lit("training")).unionByName(samples.withColumn("corpus", F.lit("samples")))
    return composition.chirality_totals(both).select("corpus", "type", "n", r6("share").alias("share"))


# ---------------------------------------------------------------- ranking

NORM = oracle("grid_summary") + ", n as (select *, exp(-power(mean_gravy_score + 0.30, 2) / (2 * 0.15 * 0.15)) as s_gravy, " + ", ".join(f"({c} - min({c}) over ()) / nullif(max({c}) over () - min({c}) over (), 0) as norm_{c}" for c in K.LINEAR_METRICS) + " from grid_summary), ut as (select *, " + ", ".join(
    " + ".join([f"{w} * {'s_gravy' if c == 's_gravy' else 'norm_' + c}" for c, w in ws.items()] + ["0.04 * norm_success_rate", "0.03 * norm_novelty_rate", "0.03 * (1 - norm_repeat_rate)"]) + f" as utility_{p}" for p, ws in K.PROFILE_WEIGHTS.items()
) + " from n)"


@query("gravy_desirability", NORM + " select config_id, round(s_gravy, 6) as s_gravy from n")
def _(spark, d):
    return ranking.gravy_desirability(view(spark, d, "grid_summary")).select("config_id", r6("s_gravy").alias("s_gravy"))


@query("minmax_metrics", NORM + " select config_id, " + ", ".join(f"round(norm_{c}, 6) as norm_{c}" for c in K.LINEAR_METRICS) + " from n")
def _(spark, d):
    return ranking.minmax(view(spark, d, "grid_summary"), K.LINEAR_METRICS).select("config_id", *[r6(f"norm_{c}").alias(f"norm_{c}") for c in K.LINEAR_METRICS])


@query("utilities", NORM + " select config_id, " + ", ".join(f"round(utility_{p}, 6) as utility_{p}" for p in K.PROFILE_WEIGHTS) + " from ut")
def _(spark, d):
    return ranking.utilities(view(spark, d, "grid_summary")).select("config_id", *[r6(f"utility_{p}").alias(f"utility_{p}") for p in K.PROFILE_WEIGHTS])


METRICS = [*K.LINEAR_METRICS[:4], "mean_gravy_score", *K.LINEAR_METRICS[4:]]


@query("top_settings", NORM + ", st as (" + " union all ".join(f"select '{p}' as profile, *, utility_{p} as utility from ut" for p in K.PROFILE_WEIGHTS) + f") select profile, cast(r as integer) as rank, species_scale, groups_scale, mic_scale, {', '.join(f'round({m}, 6) as {m}' for m in METRICS)}, round(utility, 6) as utility from (select *, row_number() over (partition by profile order by utility desc nulls last, species_scale, groups_scale, mic_scale) as r from st) x where r <= 5")
def top_settings(spark, d):
    out = ranking.top_settings(view(spark, d, "grid_summary"))
    return out.select("profile", "rank", *ranking.SCALES, *[r6(m).alias(m) for m in METRICS], r6("utility").alias("utility"))


CANDIDATES = oracle("candidates") + f""", ct as (select item_id, k, ({tokens('candidate')})[1:length] as t from candidates),
cr as (select item_id, k, {clean_sql("array_to_string(case when len(t) > 4 then t[3:len(t) - 2] else t end, '')")} as residues from ct)"""


@query("candidate_residues", CANDIDATES + " select item_id, k, residues from cr")
def _(spark, d):
    return ranking.candidate_residues(view(spark, d, "candidates")).select("item_id", "k", "residues")


@query("best_of_k", CANDIDATES + f""", e as (select *, coalesce({charge7('residues')} between 2 and 9, false) as eligible from cr),
o as (select *, row_number() over (partition by item_id order by eligible desc, case when eligible then round({diversity_sql('residues')}, 6) else 0 end desc, k) as r from e)
select item_id, k, residues, eligible from o where r = 1""")
def _(spark, d):
    return ranking.best_of_k(view(spark, d, "candidates"))


# ---------------------------------------------------------------- score tables

BLEND = oracle("scores") + """, b as (select item_id, pos, token_id, max(case when pass = 0 then score end) as u, max(case when pass = 1 then score end) as a, max(case when pass = 2 then score end) as g, max(case when pass = 3 then score end) as m from scores group by all),
blend as (select item_id, pos, token_id, (u + 1.5 * (a - u) + 1.0 * (g - u) + 2.0 * (m - u)) / 1.25 as score from b),
soft as (select item_id, pos, token_id, exp(score - max(score) over w) / sum(exp(score - mx)) over w as p from (select *, max(score) over (partition by item_id, pos) as mx from blend where token_id <> 4) x window w as (partition by item_id, pos))"""


def _blend(spark, d):
    return scores.blend_scores(view(spark, d, "scores"), {1: 1.5, 2: 1.0, 3: 2.0}, 1.25, True)


@query("blend_scores", BLEND + " select item_id, pos, token_id, round(score, 6) as score from blend")
def _(spark, d):
    # by position, so that no task before the shuffle aggregates all that it reads
    return _blend(spark, d).select("item_id", "pos", "token_id", r6("score").alias("score"))


@query("softmax_scores", BLEND + " select item_id, pos, token_id, round(p, 6) as p from soft")
def _(spark, d):
    return scores.softmax_scores(_blend(spark, d), [4]).select("item_id", "pos", "token_id", r6("p").alias("p"))


@query("draw_category", BLEND + f", g as (select *, round(ln(p + 1e-10) / 2.0 - ln(-ln({u('12', 'item_id', 'pos', 'token_id')} + 1e-10) + 1e-10), 9) as v from soft) select item_id, pos, token_id from (select *, row_number() over (partition by item_id, pos order by v desc, token_id) as r from g) x where r = 1")
def _(spark, d):
    return scores.draw_category(scores.softmax_scores(_blend(spark, d), [4]), 12, 2.0)


def flagship(spark, d, samples: DataFrame | None = None) -> DataFrame:
    """How every run did: rates and mean scores from one table of samples, in one aggregation."""
    samples = view(spark, d, "samples") if samples is None else samples
    return evaluation.run_report(evaluation.score_samples(evaluation.by_payload(samples, training(spark, d))))


REPORT = ", rates as (" + RATES.replace("[x]", "coalesce(round(100.0 * novel_count / nullif(valid_count, 0), 2), 0) as novelty_of_valid, ") + "), means as (select config_id, " + ", ".join(f"round(avg(case when scored then {n} end), 9) as mean_{n}" for n in SCORES) + " from scored group by config_id) select * from rates join means using (config_id)"


def _report(f: DataFrame) -> DataFrame:
    return f.select(*[r9(c).alias(c) if c.startswith("mean_") else c for c in f.columns])


@query("grid_report", SCORED + REPORT)
def _(spark, d):
    return _report(flagship(spark, d))


@query("grid_report_512", SCORED.replace("cast(doc_id % 8 as int) as config_id", "cast((doc_id + n) % 512 as int) as config_id") + REPORT)
def _(spark, d):
    """The published grid's shape: 512 settings, which all samples are dealt to."""
    setting = F.expr("cast((sample_id div 16777216 + sample_id % 16777216) % 512 as int)")
    return _report(flagship(spark, d, view(spark, d, "samples").withColumn("config_id", setting)))
