"""Views that give the engine's relations from general test tables, each in Spark and in DuckDB SQL.

The tables hold no spectra; keys and values are mapped so that every operator meets ties, gaps and odd cases at scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MULTIPLICITIES = ("s", "d", "t", "q", "m", "brs", "hept", "dd")
LABELS = ("alcohol", "amine", "ether", "ketone", "ester", "nitro")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), index.cast("int") + 1)


def sql_pick(index: str, values: tuple[str, ...]) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], ({index})::int + 1)"


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_index, mol_key, nmr_type, nucleus, solvent, processed, cents: raw spectral records from events."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_index"),
        F.col("user_id").alias("mol_key"),
        F.when(kind.isin("click", "view"), "1H NMR").when(kind.isin("purchase", "signup"), "13C NMR").otherwise("19F NMR").alias("nmr_type"),
        pick(F.pmod(k, F.lit(5)), ("CDCl3", "CDCl3", "DMSO-d6", "not_known", "")).alias("solvent"),
        F.when(k % 7 == 0, "").otherwise("[(1.0,)]").alias("processed"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )


RAW = f"""raw as (select event_id row_index, user_id mol_key,
  case when event_type in ('click', 'view') then '1H NMR' when event_type in ('purchase', 'signup') then '13C NMR' else '19F NMR' end nmr_type,
  {sql_pick("json_extract_string(props, '$.k')::bigint % 5", ("CDCl3", "CDCl3", "DMSO-d6", "not_known", ""))} solvent,
  case when json_extract_string(props, '$.k')::bigint % 7 = 0 then '' else '[(1.0,)]' end processed,
  round(value * 100)::bigint cents from events)"""


def h_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, pos, shift, multiplicity, J, integration: one row for each 1H peak, from lineitem."""
    # named before the window, so that grouping by id later needs no second exchange
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "id")
    half = ((F.col("l_quantity").cast("int") % 16) / 2.0).alias("j")
    mult = pick(F.col("l_suppkey") % 8, MULTIPLICITIES)
    # rows that these columns leave tied are equal in all columns of the view, so which of them comes first is the same
    pos = F.row_number().over(W.partitionBy("id").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"))
    return rows.select(
        "id",
        pos.alias("pos"),
        ((F.round(F.col("l_extendedprice") * 100).cast("bigint") % 1350) / 100.0).alias("shift"),
        mult.alias("multiplicity"),
        F.when(mult.isin("s", "m", "brs"), F.array().cast("array<double>")).otherwise(F.array(half)).alias("J"),
        (1 + F.col("l_partkey") % 9).cast("double").alias("integration"),
    )


H_PEAKS = f"""h_peaks as (select l_orderkey id,
  row_number() over (partition by l_orderkey order by l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
    l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) pos,
  (round(l_extendedprice * 100)::bigint % 1350) / 100.0::double shift, {sql_pick("l_suppkey % 8", MULTIPLICITIES)} multiplicity,
  case when {sql_pick("l_suppkey % 8", MULTIPLICITIES)} in ('s', 'm', 'brs') then null else (l_quantity::int % 16) / 2.0::double end j,
  (1 + l_partkey % 9)::double integration from lineitem)"""


def c_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, shift: one row for each 13C signal, from lineitem."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), ((F.round(F.col("l_extendedprice") * 100).cast("bigint") % 22000) / 100.0).alias("shift"))


C_SHIFTS = "c_shifts as (select l_orderkey id, (round(l_extendedprice * 100)::bigint % 22000) / 100.0::double shift from lineitem)"


def formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, formula: one for each order; some are malformed."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("C"), (1 + k % 12).cast("string"), F.lit("H"), (1 + k % 31).cast("string"), F.when(k % 3 == 0, "O").when(k % 3 == 1, "N2").otherwise("ClBr"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 17 == 0, F.concat(text, F.lit(".Na"))).when(k % 19 == 0, F.lit("")).otherwise(text).alias("formula"))


FORMULAS = """formulas as (select o_orderkey id, case when o_orderkey % 17 = 0 then f || '.Na' when o_orderkey % 19 = 0 then '' else f end formula
  from (select o_orderkey, 'C' || (1 + o_orderkey % 12) || 'H' || (1 + o_orderkey % 31) ||
    case o_orderkey % 3 when 0 then 'O' when 1 then 'N2' else 'ClBr' end f from orders) x)"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality manifest's columns from part, without status, reasons and split; violations is an array."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.cast("string").alias("id"),
        F.concat(F.lit("mol-"), (k % 400).cast("string")).alias("canonical_smiles"),
        F.when(k % 23 != 0, F.concat(F.lit("C"), (1 + F.col("p_size") % 20).cast("string"), F.lit("H8"))).alias("molecular_formula"),
        F.when(k % 11 == 0, F.array(F.lit("multiple_components"), F.lit("nonzero_formal_charge")))
        .when(k % 11 == 1, F.array(F.lit("radical")))
        .otherwise(F.array().cast("array<string>"))
        .alias("violations"),
        F.when(k % 13 == 0, 1).otherwise(0).alias("isotope_label_count"),
        F.when(k % 29 != 0, F.col("p_brand")).alias("murcko_scaffold"),
        F.col("p_size").cast("int").alias("heavy_atom_count"),
        (k % 90).cast("int").alias("h_peak_count"),
        (k % 131).cast("int").alias("c_peak_count"),
        pick(k % 5, ("CDCl3", "CDCl3", "DMSO-d6", "not_known", "")).alias("h_solvent"),
        pick(k % 7, ("CDCl3", "CDCl3", "CDCl3", "DMSO-d6", "D2O", "nan", "")).alias("c_solvent"),
    )


MANIFEST = f"""manifest as (select p_partkey::varchar id, 'mol-' || (p_partkey % 400) canonical_smiles,
  case when p_partkey % 23 <> 0 then 'C' || (1 + p_size % 20) || 'H8' end molecular_formula,
  case when p_partkey % 11 = 0 then ['multiple_components', 'nonzero_formal_charge'] when p_partkey % 11 = 1 then ['radical'] else [] end violations,
  case when p_partkey % 13 = 0 then 1 else 0 end isotope_label_count,
  case when p_partkey % 29 <> 0 then p_brand end murcko_scaffold, p_size::int heavy_atom_count,
  (p_partkey % 90)::int h_peak_count, (p_partkey % 131)::int c_peak_count,
  {sql_pick("p_partkey % 5", ("CDCl3", "CDCl3", "DMSO-d6", "not_known", ""))} h_solvent,
  {sql_pick("p_partkey % 7", ("CDCl3", "CDCl3", "CDCl3", "DMSO-d6", "D2O", "nan", ""))} c_solvent from part),
checked as (select *, list_filter(list_concat(violations, [case when molecular_formula is null then 'missing_formula' end,
    case when murcko_scaffold is null then 'missing_scaffold' end, case when h_peak_count <= 0 then 'missing_1h_peaks' end,
    case when c_peak_count <= 0 then 'missing_13c_peaks' end]), lambda x: x is not null) reasons from manifest),
qc as (select * exclude (reasons, violations), violations, case when len(reasons) = 0 then 'pass' else 'fail' end qc_status,
  array_to_string(reasons, ';') qc_reason from checked)"""


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, smiles, formula, ring_scaffold, groups, bits: candidates for same-formula search, from embeddings."""
    v = F.col("embedding")
    bits = F.filter(F.transform(v, lambda x, i: F.when(x > 0, i)), lambda x: x.isNotNull())
    groups = F.filter(F.transform(F.array(*(F.lit(i) for i in range(len(LABELS)))), lambda i: F.when(F.get(v, i) > 0, pick(i, LABELS))), lambda x: x.isNotNull())
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"),
        F.concat(F.lit("m"), (F.col("vec_id") % 450).cast("string")).alias("smiles"),
        F.concat(F.lit("C"), F.col("label").cast("string")).alias("formula"),
        F.when(F.col("vec_id") % 450 % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("ring"), (F.col("vec_id") % 450 % 5).cast("string"))).alias("ring_scaffold"),
        groups.alias("groups"),
        bits.alias("bits"),
    )


MOLECULES = f"""molecules as (select vec_id::varchar id, 'm' || (vec_id % 450) smiles, 'C' || label formula,
  case when vec_id % 450 % 3 = 0 then '' else 'ring' || (vec_id % 450 % 5) end ring_scaffold,
  list_filter(list_transform(range({len(LABELS)}), lambda i: case when embedding[i + 1] > 0 then {sql_pick("i", LABELS)} end), lambda x: x is not null) groups,
  list_filter(list_transform(range(len(embedding)), lambda i: case when embedding[i + 1] > 0 then i end), lambda x: x is not null) bits
  from embeddings)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, reference, prediction (model text), formula: from orders. Structures with the digit 7 count as not valid."""
    k = F.col("o_orderkey")
    ref = F.concat(F.lit("C"), (k % 97).cast("string"), F.lit("O"))
    guess = F.when(k % 4 == 0, ref).otherwise(F.concat(F.lit("C"), (k % 83).cast("string"), F.lit("O")))
    quoted = F.concat(F.lit('{"smiles":"'), guess, F.lit('"}'))
    text = (
        F.when(k % 9 == 0, quoted)
        .when(k % 9 == 1, F.concat(F.lit("Sure:\n```json\n"), quoted, F.lit("\n```")))
        .when(k % 9 == 2, guess)
        .when(k % 9 == 3, F.concat(F.lit("I think so.\nFinal SMILES: "), guess, F.lit(" ok")))
        .when(k % 9 == 4, F.lit('{"smiles":null}'))
        .when(k % 9 == 5, F.concat(F.lit("```smiles\n"), guess, F.lit("\n```")))
        .when(k % 9 == 6, F.concat(F.lit('{"name":"f","arguments":'), quoted, F.lit("}")))
        .when(k % 9 == 7, F.concat(F.lit("first\n  "), guess, F.lit("  \n")))
        .otherwise(F.lit('{"answer":1}'))
    )
    return table(spark, sf_dir, "orders").select(k.alias("id"), ref.alias("reference"), text.alias("prediction"))


PREDICTIONS = """predictions as (select id, ref reference, guess, k, case k when 0 then q when 1 then 'Sure:' || chr(10) || '```json' || chr(10) || q || chr(10) || '```'
    when 2 then guess when 3 then 'I think so.' || chr(10) || 'Final SMILES: ' || guess || ' ok' when 4 then '{"smiles":null}'
    when 5 then '```smiles' || chr(10) || guess || chr(10) || '```' when 6 then '{"name":"f","arguments":' || q || '}'
    when 7 then 'first' || chr(10) || '  ' || guess || '  ' || chr(10) else '{"answer":1}' end prediction
  from (select *, '{"smiles":"' || guess || '"}' q from (select o_orderkey id, o_orderkey % 9 k, 'C' || (o_orderkey % 97) || 'O' ref,
    case when o_orderkey % 4 = 0 then 'C' || (o_orderkey % 97) || 'O' else 'C' || (o_orderkey % 83) || 'O' end guess from orders) a) b)"""


DEEPEST = 20
WRAPPERS = ("[$]", '{"arguments":$}', '{"name":"f","function":$}', '[3,{"id":1},$,{"smiles":"last"}]', '{"arguments":"none","function":$}')


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, prediction: a JSON text nested up to DEEPEST times, in every mixture of WRAPPERS, some of it fenced, as JSON text in
    arguments, without the key or broken; from orders."""
    k = F.col("o_orderkey")
    value = F.when(k % 7 == 0, F.lit("null")).when(k % 7 == 1, F.lit('"  "')).otherwise(F.concat(F.lit('"C'), (k % 83).cast("string"), F.lit('O"')))
    core = F.when(k % 11 == 0, F.lit('{"answer":1}')).otherwise(F.concat(F.lit('{"smiles":'), value, F.lit("}")))
    levels = F.sequence(F.lit(0), (k % (DEEPEST + 1)).cast("int"))
    text = F.aggregate(levels, core, lambda t, i: F.when(i == 0, t).otherwise(F.replace(pick(F.floor(k / 21 + i * i) % len(WRAPPERS), WRAPPERS), F.lit("$"), t)))
    quoted = F.concat(F.lit('{"arguments":"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"}'))
    text = F.when(k % 5 == 0, quoted).when(k % 5 == 1, F.concat(F.lit("Here:\n```\nno\n```\n```json\n"), text, F.lit("\n```"))).when(k % 13 == 2, F.concat(text, F.lit("}"))).otherwise(text)
    return table(spark, sf_dir, "orders").select(k.alias("id"), text.alias("prediction"))


NESTED = f"""nested as (select k id, case when k % 5 = 0 then '{{"arguments":"' || replace(replace(t, '\\', '\\\\'), '"', '\\"') || '"}}'
    when k % 5 = 1 then 'Here:' || chr(10) || '```' || chr(10) || 'no' || chr(10) || '```' || chr(10) || '```json' || chr(10) || t || chr(10) || '```'
    when k % 13 = 2 then t || '}}' else t end prediction
  from (select k, list_reduce(list_prepend(core, list_transform(range(1, k % {DEEPEST + 1} + 1),
      lambda i: {sql_pick(f"(k // 21 + i * i) % {len(WRAPPERS)}", WRAPPERS)})), lambda t, w: replace(w, '$', t)) t
    from (select o_orderkey k, case when o_orderkey % 11 = 0 then '{{"answer":1}}' else '{{"smiles":' || case o_orderkey % 7 when 0 then 'null' when 1 then '"  "'
      else '"C' || (o_orderkey % 83) || 'O"' end || '}}' end core from orders) a) b)"""


def valid_structure(smiles: Column) -> Column:
    return smiles.isNotNull() & ~F.contains(smiles, F.lit("7"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, pos, connectivity, accepted, isotopes, formula, wanted, support: generated candidates, from lineitem."""
    rows = h_peaks(spark, sf_dir).select("id", "pos", F.col("shift").alias("s"), F.col("integration").alias("n"))
    cents = F.round(F.col("s") * 100).cast("bigint")
    return rows.select(
        "id",
        "pos",
        F.concat(F.lit("c"), (cents % 4).cast("string")).alias("connectivity"),
        (cents % 10 != 0).alias("accepted"),
        F.when(cents % 15 == 0, 1).otherwise(0).alias("isotopes"),
        F.concat(F.lit("F"), (cents % 4 % 2).cast("string")).alias("formula"),
        F.when(F.col("id") % 6 != 0, F.concat(F.lit("F"), (F.col("id") % 2).cast("string"))).alias("wanted"),
        F.when(cents % 4 != 3, (cents % 4) / 4.0).alias("support"),
    )


CANDIDATES = f"""{H_PEAKS}, candidates as (select id, pos, 'c' || (c % 4) connectivity, c % 10 <> 0 accepted, case when c % 15 = 0 then 1 else 0 end isotopes,
  'F' || (c % 4 % 2) formula, case when id % 6 <> 0 then 'F' || (id % 2) end wanted, case when c % 4 <> 3 then (c % 4) / 4.0::double end support
  from (select *, round(shift * 100)::bigint c from h_peaks) x)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, predicted, reference: label sets, from documents and labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "source")
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    given = F.filter(F.array(F.col("lang"), F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull())
    guess = F.filter(
        F.array(F.when(F.col("doc_id") % 7 == 0, "en").otherwise(F.col("lang")), F.when(F.col("n_chars") % 10 > 1, "good"), F.when(F.col("n_chars") % 13 == 0, "toxic"), F.when(F.col("n_chars") % 101 == 0, "odd")),
        lambda x: x.isNotNull(),
    )
    return rows.select(F.col("doc_id").alias("id"), guess.alias("predicted"), given.alias("reference"))


LABELLED = """labelled as (select d.doc_id id, list_filter([case when d.doc_id % 7 = 0 then 'en' else lang end, case when n_chars % 10 > 1 then 'good' end,
    case when n_chars % 13 = 0 then 'toxic' end, case when n_chars % 101 = 0 then 'odd' end], lambda x: x is not null) predicted,
  list_filter([lang, case when quality = 1 then 'good' end, case when toxic = 1 then 'toxic' end], lambda x: x is not null) reference
  from documents d join labels l on d.doc_id = l.doc_id)"""


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, prediction, tokens: word ids of the whole text; an end token is where a word ends in '.' and its length is 5."""
    words = F.filter(F.split("text", "[ \n]+"), lambda w: w != "")
    tokens = F.transform(words, lambda w: F.when(w.endswith(".") & (F.length(w) == 5), F.lit(2)).otherwise(3 + F.ascii(w) * 100 + F.length(w)))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 8).alias("prediction"), tokens.alias("tokens"))


TOKENS = """token_rows as (select doc_id id, substr(text, 1, 8) prediction, list_transform(list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> ''),
  lambda w: case when w like '%.' and length(w) = 5 then 2 else 3 + unicode(w) * 100 + length(w) end) tokens from documents)"""
