"""Queries of scalar functions, prompts and chat."""

from __future__ import annotations

from pyspark.sql import functions as F

from specloom.functions import outputs, parsing
from specloom.operators import tasks
from specloom.plans import adapters as A
from specloom.plans.registry import registry

QUERIES, SQL, query = registry()

NUMBER = r"[-+]?[0-9]*\.?[0-9]+"


@query(f"""select p_partkey id, try_cast(nullif(regexp_extract(t, '{NUMBER}'), '') as double) number, case when try_cast(nullif(regexp_extract(t, '{NUMBER}'), '') as double) > 0
    then try_cast(nullif(regexp_extract(t, '{NUMBER}'), '') as double) else 400.0::double end mhz, coalesce(try_cast(nullif(regexp_extract(t, '{NUMBER}'), '') as double), 1.0::double) integration
  from (select p_partkey, case p_partkey % 5 when 0 then p_name when 1 then p_size || ' MHz' when 2 then '-' || p_size || '.5H' when 3 then 'J=.' || p_size else p_brand end t from part) x""")
def f1_parse_number(spark, d):
    k = F.col("p_partkey") % 5
    size = F.col("p_size").cast("string")
    t = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(size, F.lit(" MHz"))).when(k == 2, F.concat(F.lit("-"), size, F.lit(".5H"))).when(k == 3, F.concat(F.lit("J=."), size)).otherwise(F.col("p_brand"))
    rows = A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), t.alias("t"))
    return rows.select("id", parsing.parse_number(F.col("t")).alias("number"), parsing.frequency_mhz(F.col("t")).alias("mhz"), parsing.integration(F.col("t")).alias("integration"))


@query(f"""select id, array_to_string(list_transform(list_filter(list_transform(v, lambda x: try_cast(nullif(regexp_extract(x, '{NUMBER}'), '') as double)), lambda x: x is not null),
    lambda x: (x * 10)::bigint::varchar), ',') js from (select p_partkey id, [p_size || '.5Hz', p_type, 'x' || (p_partkey % 9), null] v from part) y""")
def f5_couplings(spark, d):
    v = F.array(F.concat(F.col("p_size").cast("string"), F.lit(".5Hz")), F.col("p_type"), F.concat(F.lit("x"), (F.col("p_partkey") % 9).cast("string")), F.lit(None).cast("string"))
    text = F.array_join(F.transform(parsing.couplings(v), lambda x: (x * 10).cast("bigint").cast("string")), ",")
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("js"))


RAW_MULT = ("app d", " Sept ", "", "BS", "quintet", "app t", "multiplet", "broad", "d d")


@query(f"""with x as (select o_orderkey id, case when o_orderkey % 10 = 9 then null else {A.sql_pick("o_orderkey % 9", RAW_MULT)} end t from orders),
y as (select id, t, regexp_replace(lower(replace(trim(t), ' ', '')), '^app', '') c from x)
select id, case when t is null or trim(t) = '' then 's' else case c when 'bs' then 'brs' when 'broad' then 'br' when 'sept' then 'hept' when 'quint' then 'p' when 'quintet' then 'p'
  when 'multiplet' then 'm' else c end end multiplicity from y""")
def f6_multiplicity(spark, d):
    t = F.when(F.col("o_orderkey") % 10 != 9, A.pick(F.col("o_orderkey") % 9, RAW_MULT))
    return A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), parsing.multiplicity(t).alias("multiplicity"))


@query("select p_partkey, 'nmr-' || substr(sha256(p_name), 1, 16) id, substr(regexp_replace(p_name || '/' || p_type, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 200) key from part")
def f10_stable_id(spark, d):
    return A.table(spark, d, "part").select("p_partkey", parsing.stable_id(F.col("p_name")).alias("id"), parsing.file_key(F.concat("p_name", F.lit("/"), "p_type")).alias("key"))


@query("""select o_orderkey id, case when o_orderkey % 6 = 0 then 0 else coalesce(trunc(try_cast(t as double))::int, 0) end n from (select o_orderkey, case o_orderkey % 6 when 1 then o_totalprice::varchar
  when 2 then '12.9' when 3 then '-3.7' when 4 then o_orderpriority else (o_orderkey % 1000)::varchar end t from orders) x""")
def f24_to_int(spark, d):
    k = F.col("o_orderkey") % 6
    t = F.when(k == 0, F.lit(None)).when(k == 1, F.col("o_totalprice").cast("string")).when(k == 2, F.lit("12.9")).when(k == 3, F.lit("-3.7")).when(k == 4, F.col("o_orderpriority")).otherwise((F.col("o_orderkey") % 1000).cast("string"))
    return A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), parsing.to_int(t).alias("n"))


WEIGHTS = {tasks.STRUCTURE: 3.0, tasks.GROUPS: 1.0, tasks.REGIONS: 0.5}


@query(f"""select o_orderkey id, case when x < {3.0 / 4.5!r}::double then '{tasks.STRUCTURE}' when x < {3.0 / 4.5 + 1.0 / 4.5!r}::double then '{tasks.GROUPS}' else '{tasks.REGIONS}' end task
  from (select o_orderkey, ('0x' || substr(sha256('7:' || o_orderkey || ':task'), 1, 16))::ubigint::double / 18446744073709551616.0::double x from orders) y""")
def f18_task_draw(spark, d):
    return A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), parsing.weighted_draw(7, F.col("o_orderkey").cast("string"), WEIGHTS).alias("task"))


@query(f"""with {A.H_PEAKS}, {A.C_SHIFTS}, h as (select id, string_agg(printf('%.2f', shift) || ' ppm | ' || multiplicity || ' | J=' || coalesce(printf('%.1f', j), '-') || ' Hz | integration=' || integration::int,
    chr(10) order by shift desc, pos) t from h_peaks group by 1), c as (select id, string_agg(printf('%.2f', shift), ', ' order by shift desc) t from c_shifts group by 1)
select h.id, '1H NMR:' || chr(10) || h.t || chr(10) || chr(10) || '13C NMR:' || chr(10) || c.t || ' ppm' peak_table from h join c on h.id = c.id""")
def f19_peak_table(spark, d):
    h = A.h_peaks(spark, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "shift", "multiplicity", "J", "integration"))).alias("h"))
    c = A.c_shifts(spark, d).groupBy("id").agg(F.collect_list("shift").alias("c"))
    return h.join(c, "id").select("id", parsing.peak_table(F.col("h"), F.col("c")).alias("peak_table"))


@query(f"""with {A.FORMULAS} select id, case when trim(formula) = '' then null else '{tasks.OPENINGS[0].replace("'", "''")}' || chr(10) || chr(10) || 'Molecular formula: ' || formula || chr(10) || chr(10)
  || 'tables' || chr(10) || chr(10) || '{tasks.OUTPUT}' end prompt from formulas""")
def f20_structure_prompt(spark, d):
    body = tasks.context(F.lit("tables"), F.col("formula"))
    return A.formulas(spark, d).select("id", tasks.structure_prompt(F.lit(0), body).alias("prompt"))


@query(f"""with {A.H_PEAKS}, w as (select id, multiplicity m, min(pos) p from h_peaks group by 1, 2), r as (select *, row_number() over (partition by id order by p) n from w)
select id, string_agg(n || '. ' || m, chr(10) order by n) listing from r group by 1""")
def f22_numbered_candidates(spark, d):
    rows = A.h_peaks(spark, d).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "multiplicity"))), lambda x: x["multiplicity"]).alias("m"))
    return rows.select("id", parsing.numbered(F.col("m")).alias("listing"))


@query("""select p_partkey id, case when p_partkey % 4 = 0 then '{"smiles":null}' else '{"smiles":"' || p_name || '"}' end target from part""")
def f23_json_target(spark, d):
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), tasks.smiles_target(F.when(F.col("p_partkey") % 4 != 0, F.col("p_name"))).alias("target"))


@query(f"with {A.C_SHIFTS} select id, count(distinct round(shift * 1000))::int signals from c_shifts group by 1")
def f26_distinct_signals(spark, d):
    return A.c_shifts(spark, d).groupBy("id").agg(F.collect_list("shift").alias("s")).select("id", parsing.distinct_signals(F.col("s")).alias("signals"))


@query(f"""with {A.PREDICTIONS} select id, case when k in (0, 1) then q0 when k = 4 then '{{"smiles":null}}' when k = 6 then '{{"name":"f","arguments":' || q0 || '}}' when k = 8 then '{{"answer":1}}' end payload
  from (select *, '{{"smiles":"' || guess || '"}}' q0 from predictions) x""")
def f14_json_payload(spark, d):
    return A.predictions(spark, d).select("id", outputs.payload(F.col("prediction")).alias("payload"))


@query(f"with {A.PREDICTIONS} select id, case when k in (4, 8) then null else guess end smiles from predictions")
def f16_extract_smiles(spark, d):
    return A.predictions(spark, d).select("id", outputs.final_smiles(F.col("prediction")).alias("smiles"))


@query(f"""with {A.PREDICTIONS} select id, case when k in (0, 1, 6) then case when guess like '%7%' then 'invalid' else 'compliant' end when k = 4 then 'compliant'
  when k = 2 and guess like '%7%' then 'invalid' else 'non_bare' end state from predictions""")
def f17_output_state(spark, d):
    return A.predictions(spark, d).select("id", outputs.output_state(F.col("prediction"), A.valid_structure).alias("state"))


@query(f"""with recursive {A.NESTED}, tried as (select id, unnest(t) t, generate_subscripts(t, 1) n
    from (select id, list_concat([trim(prediction)], list_transform(regexp_extract_all(prediction, '```(?:json)?\\s*\\n?(.*?)```', 1, 'is'), lambda x: trim(x, ' ' || chr(10)))) t from nested) x),
  chosen as (select id, arg_min(t, n) t from tried where json_valid(t) group by 1),
  walk(id, place, j) as (select id, [0]::bigint[], t::json from chosen union all
    select id, list_append(place, n), part from (
      select w.id, w.place, unnest(range(0, len(parts))) n, unnest(parts) part from (
        select id, place, case when json_type(j) = 'ARRAY' then json_extract(j, '$[*]')
          when json_type(j) = 'OBJECT' and not json_exists(j, '$.smiles') then list_filter([
            case when json_type(j, '$.arguments') = 'VARCHAR' then case when json_valid(json_extract_string(j, '$.arguments')) then json_extract_string(j, '$.arguments')::json end
              else json_extract(j, '$.arguments') end, json_extract(j, '$.function')], lambda x: x is not null) else [] end parts from walk) w) y),
  seen as (select id, true has, arg_min(nullif(trim(json_extract_string(j, '$.smiles')), ''), place) filter (nullif(trim(json_extract_string(j, '$.smiles')), '') is not null) smiles
    from walk where json_type(j) = 'OBJECT' and json_exists(j, '$.smiles') group by 1),
  answer as (select n.id, c.id is not null parsed, coalesce(s.has, false) has, s.smiles, n.prediction from nested n left join chosen c on n.id = c.id left join seen s on n.id = s.id)
select id, parsed, parsed and has has_smiles, case when parsed then smiles else trim(prediction) end smiles,
  case when not parsed then 'other' when not has then 'non_bare' when smiles is null then 'compliant' when smiles like '%7%' then 'invalid' else 'compliant' end state from answer""")
def f15_nested_smiles(spark, d):
    json, text = outputs.read(F.col("prediction")), F.col("prediction")
    parsed = json["payload"].isNotNull()
    state = F.when(parsed, outputs.output_state(text, A.valid_structure)).otherwise(F.lit("other"))
    return A.nested(spark, d).select("id", parsed.alias("parsed"), F.coalesce(json["has_smiles"], F.lit(False)).alias("has_smiles"), outputs.final_smiles(text).alias("smiles"), state.alias("state"))


CHAT = "chats as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) rn, count(*) over (partition by conv_id) n from conversations)"


def _chats(spark, d):
    rows = A.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return rows.withColumn("chat", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))))


@query("""select conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by turn) rendered from conversations group by 1""")
def g3_render_chat(spark, d):
    return _chats(spark, d).select("conv_id", tasks.render(F.col("chat")).alias("rendered"))


@query(f"""with {CHAT}, l as (select * from chats where rn = n) select conv_id, case when n < 2 then 'too_short' when role <> 'assistant' then 'last_role' when coalesce(trim(text), '') = '' then 'empty_response' end fault from l""")
def g3_prefix_faults(spark, d):
    return _chats(spark, d).select("conv_id", tasks.prefix_faults(F.col("chat")).alias("fault"))


@query(f"""select p_partkey id, 'system' r1, 'user' r2, 'assistant' r3, p_name prompt, '{{"smiles":"' || p_brand || '"}}' target,
  ('0x' || substr(sha256('3:' || p_partkey || ':template'), 1, 8))::bigint % {len(tasks.OPENINGS)} template from part""")
def g2_messages(spark, d):
    rows = A.table(spark, d, "part").withColumn("m", tasks.messages(F.lit(tasks.SYSTEM), F.col("p_name"), tasks.smiles_target(F.col("p_brand"))))
    role = lambda i: F.get("m", i)["role"].alias(f"r{i + 1}")
    return rows.select(F.col("p_partkey").alias("id"), role(0), role(1), role(2), F.get("m", 1)["content"].alias("prompt"), F.get("m", 2)["content"].alias("target"), tasks.template_index(3, F.col("p_partkey").cast("string")).alias("template"))


@query(f"""with {A.TOKENS} select id, array_to_string(list_transform(tokens, lambda x, i: case when i - 1 >= len(tokens) // 3 and i - 1 < len(tokens) // 3 + 5 then x else -100 end), ' ') labels from token_rows""")
def g4_label_mask(spark, d):
    start = F.floor(F.size("tokens") / 3)
    return A.token_rows(spark, d).select("id", F.array_join(tasks.response_mask(F.col("tokens"), start, F.lit(5)).cast("array<string>"), " ").alias("labels"))


@query("""select doc_id id, case when doc_id % 7 = 0 then 'length_mismatch' when doc_id % 7 = 1 then 'no_supervised_tokens' when doc_id % 7 = 2 then 'think_tag'
  when doc_id % 7 = 3 and regexp_replace(text, '[ \\n\\t\\r\\f\\v]+', '', 'g') <> regexp_replace(text || 'x', '[ \\n\\t\\r\\f\\v]+', '', 'g') then 'target_mismatch' end fault from documents""")
def g5_mask_validation(spark, d):
    k = F.col("doc_id") % 7
    ids = F.array(F.lit(5), F.lit(6))
    labels = F.when(k == 0, F.array(F.lit(5))).when(k == 1, F.array(F.lit(-100), F.lit(-100))).otherwise(F.array(F.lit(-100), F.lit(6)))
    decoded = F.when(k == 2, F.concat(F.lit("<think> "), "text")).when(k == 3, F.concat("text", F.lit("x"))).otherwise(F.concat(F.lit(" "), "text", F.lit("\n")))
    return A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), tasks.mask_faults(ids, labels, decoded, F.col("text")).alias("fault"))


@query("""select conv_id, arg_max(text, turn) as text from conversations where role = 'assistant' and trim(text) <> '' group by 1""")
def g6_last_assistant(spark, d):
    return tasks.last_assistant(A.table(spark, d, "conversations"))
