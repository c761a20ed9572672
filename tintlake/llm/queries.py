"""The registered queries of the operators, opN_<name>, and their oracle SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintlake.llm import decontaminate, hard_negatives, minhash, packing, periodic, pii, quality, search, secrets, substring_dedup, tool_calls, url_filter, wavelet
from tintlake.llm.common import table
from tintlake.runtime import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


@_query(
    "op3_substring_dedup",
    """
with w as (
  select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos
  from (select doc_id, [x for x in string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if x <> ''] as ws from documents)
), t as (
  select doc_id, pos, word,
    case when count(*) over f = 35 then string_agg(word, ' ') over f end as win
  from w window f as (partition by doc_id order by pos rows between current row and 34 following)
), c as (
  select doc_id, pos, word, case when win is not null and count(*) over (partition by win) > 1 then 1 else 0 end as dup from t
), r as (
  select doc_id, pos, word, max(dup) over (partition by doc_id order by pos rows between 34 preceding and current row) as gone from c
), k as (
  select doc_id, count(*) as n_words, sum(gone) as n_removed, coalesce(string_agg(word, ' ' order by pos) filter (where gone = 0), '') as kept from r group by doc_id
)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join k using (doc_id)
""",
)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_query("op9_minhash_near_dedup")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"))


@_query("op8_best_fit_packing")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query("op5_token_shards")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    wavelet.write_token_shards(table(spark, sf, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return wavelet.read_documents(spark, folder)


@_query("op10_quality_rules")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@_query("op1_personal_data")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = pii.with_personal_data(docs, pii.train(docs), with_text=False).select("doc_id", F.col("pii.spans").alias("s"))
    base = F.filter("s", lambda x: x["base"])
    counts = [F.size(F.filter(base, _of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("s")).alias("spans"))


@_query("op2_benchmark_matches")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


@_query(
    "op4_url_rules",
    """
with p as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages
), q as (
  select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from p
), r(rh, rp, v) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m as (
  select page_id, host, path, arg_max({'rule': rh || rp, 'v': v}, length(rh) + length(rp)) as best
  from q left join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id, host, path
)
select page_id, host, path, best.rule as rule, coalesce(best.v, 'allow') as verdict from m
""",
)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf, "pages"), rules)


@_query("op6_bm25_top_k")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """Queries: every document whose id is divisible by 20, its whole text, against all documents."""
    docs = table(spark, sf, "documents")
    return search.top_k(search.build_index(docs), docs.filter("doc_id % 20 = 0"), "doc_id", "text")


@_query(
    "op6_bm25_benchmark_items",
    r"""
with q as (
  select item_id as query, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+')) as term
  from benchmark where item_id % 20 = 0
), qc as (
  select query, term, count(*) as qn from q group by all
), w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') as ts from documents
), n as (
  select count(*) as docs, sum(len(ts)) / count(*) as mean from w
), tf as (
  select doc_id, term, dl, count(*) as tf from (select doc_id, len(ts) as dl, unnest(ts) as term from w) where term in (select term from qc) group by all
), idf as (
  select term, ln(1 + (docs - count(*) + 0.5) / (count(*) + 0.5)) as idf from tf, n group by term, docs
), s as (
  select query, doc_id, round(sum(qn * idf * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) as score
  from qc join tf using (term) join idf using (term), n group by query, doc_id
)
select query, doc_id, score, rank::int as rank
from (select *, row_number() over (partition by query order by score desc, doc_id) as rank from s) where rank <= 10
""",
)
def op6_items(spark: SparkSession, sf: str) -> DataFrame:
    """Queries: every benchmark item whose id is divisible by 20, against all documents."""
    index = search.build_index(table(spark, sf, "documents"))
    queries = table(spark, sf, "benchmark").filter("item_id % 20 = 0")
    return search.top_k(index, queries, "item_id", "text")


ASK_SCHEMA = '{"properties":{"prompt":{"type":"string"},"turn":{"type":"integer"}},"required":["prompt","turn"]}'


@_query(
    "op7_tool_calls",
    """
with u as (
  select conv_id, turn, text, dense_rank() over (partition by conv_id order by turn) - 1 as depth from conversations where role = 'user'
), a as (
  select conv_id, turn - 1 as turn, min(text) as text from conversations where role = 'assistant' group by all
), r as (
  select coalesce(u.conv_id, a.conv_id) as conv_id, coalesce(u.turn, a.turn) as turn, u.turn is not null as has_call, a.turn is not null as has_result, u.depth, u.text as prompt, a.text as content
  from u full join a on u.conv_id = a.conv_id and u.turn = a.turn
)
select conv_id, 't' || lpad(turn::varchar, 6, '0') as call_id, case when has_call then depth end::bigint as position, case when has_call then depth end::int as depth,
  case when not has_call then 'no_call' when prompt is null then 'bad_arguments' when not has_result then 'no_result' else 'ok' end as status,
  '{"arguments":' || case when has_call then '{' || case when prompt is null then '' else '"prompt":' || to_json(prompt) || ',' end || '"turn":' || turn || '}' else 'null' end
  || ',"id":"t' || lpad(turn::varchar, 6, '0') || '","name":' || case when has_call then '"ask"' else 'null' end || ',"result":' || coalesce(to_json(content)::varchar, 'null') || '}' as json
from r
""",
)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """Every user turn is a call of the tool ``ask`` that follows the conversation's user turn before it; the assistant
    turn after it is the result. Both are derived as JSON messages and read back by the operator."""
    turns = table(spark, sf, "conversations")
    name = lambda turn: F.concat(F.lit("t"), F.lpad(turn.cast("string"), 6, "0"))
    users = turns.filter("role = 'user'").select("conv_id", "turn", "text")
    after = F.array(name(F.col("turn") - 2))  # speakers take turns; what does not exist is ignored
    call = F.struct(name(F.col("turn")).alias("id"), F.lit("ask").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"), "turn")).alias("arguments"), after.alias("after"))
    calls = users.select("conv_id", "turn", F.to_json(F.struct(F.array(call).alias("tool_calls"))).alias("text"))
    answer = F.struct(name(F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content"))
    answers = turns.filter("role = 'assistant'").select("conv_id", "turn", F.to_json(answer).alias("text"))
    found = tool_calls.read_messages(calls.unionByName(answers))
    schemas = spark.createDataFrame([("ask", ASK_SCHEMA)], "name string, schema string")
    return tool_calls.link_tool_calls(*found, schemas)


def _secrets_sql() -> str:
    """Spans from the texts between the matches: a match begins where the pieces and matches before it end."""
    parts = []
    for k, r in enumerate(secrets.RULES):
        pattern = r.pattern.replace("'", "''")
        kept = f"length(x.grp) >= {r.least}" + (f" and regexp_full_match(x.hit, '{r.whole}')" if r.whole else "")
        parts.append(
            f"""select doc_id, {k} as k, '{r.kind}' as kind, x.start as s, x.start + length(x.hit) as e from (
 select doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'hit': m[i], 'grp': g[i], 'start':
   (list_sum(list_transform(p[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0))::bigint}})) as x
 from (select doc_id, regexp_extract_all(text, '{pattern}') as m, regexp_extract_all(text, '{pattern}', {r.group}) as g, string_split_regex(text, '{pattern}') as p
  from documents where regexp_matches(text, '{pattern}'))) where {kept}"""
        )
    base = [r.kind for r in secrets.RULES if r.base]
    counts = ", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in base)
    joined = "string_agg(kind || ':' || s || ':' || e, ',' order by s, k)"
    return f"""
with f as ({" union all ".join(parts)}), a as (
  select doc_id, {counts}, {joined} filter (where k < {len(base)}) as base, {joined} as spans from f group by doc_id
)
select d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::bigint as n_{k}" for k in base)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join a using (doc_id)"""


@_query("op11_secret_scan", _secrets_sql())
def op11(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = secrets.with_secrets(docs, with_text=False).select("doc_id", F.col("secrets.spans").alias("s"))
    base = F.filter("s", lambda x: x["base"])
    counts = [F.size(F.filter("s", _of_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in secrets.RULES if r.base]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("s")).alias("spans"))


def _with_repeats(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth, by a hash of the id, go on periodically from some word."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    marked = docs.withColumns({"g": F.floor(h / 10).cast("long"), "words": F.when(h % 10 == 0, words)}).withColumn("n", F.size("words").cast("long"))
    marked = marked.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    marked = marked.withColumn("p", F.expr("(1 + (n - a) div (3 + g % 8))"))
    tail = "slice(flatten(array_repeat(slice(words, int(a + 1), int(p)), int((n - a) div p + 1))), 1, int(n - a))"
    changed = F.expr(f"array_join(concat(slice(words, 1, int(a)), {tail}), ' ')")
    return marked.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


@_query(
    "op12_periodic_runs",
    """
with recursive bits as (
  select doc_id, text, list_reduce(list_prepend(4294967295::bigint, [ord(c)::bigint for c in string_split(doc_id::varchar, '')]),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)) as c
  from documents
), w as (
  select doc_id, xor(c, 4294967295) as h, [x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] as ws from bits
), ap as (
  select *, h // 10 as g, len(ws) as n, case when h % 10 = 0 and len(ws) > 0 then (h // 10) % len(ws) end as a from w
), pp as (
  select *, 1 + (n - a) // (3 + g % 8) as p from ap
), d as materialized (
  select doc_id, case when a is null then ws else [ws[(case when i < a then i else a + (i - a) % p end) + 1] for i in range(n)] end as ws from pp
), t as materialized (
  select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as i, len(ws) as n from d
), e as (
  select x.doc_id, x.i, x.i - y.i as p from t x join t y on x.doc_id = y.doc_id and x.word = y.word and y.i < x.i and 4 * (x.i - y.i) <= x.n
), s as (
  select doc_id, p, min(i) - p as start, max(i) + 1 as stop from (select *, i - row_number() over (partition by doc_id, p order by i) as island from e)
  group by doc_id, p, island having count(*) >= greatest(3 * p, 6 - p)
), r as materialized (
  select doc_id, start, stop - start as length, min(p) as period from s group by doc_id, start, stop
), b as (
  select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as runs from r group by doc_id
), m as (
  select * from r x where not exists (select 1 from r y where y.doc_id = x.doc_id and (y.length * x.period > x.length * y.period
    or (y.length * x.period = x.length * y.period and (y.start, y.period) < (x.start, x.period))))
), k as (
  select doc_id, string_agg(word, ' ' order by i) as kept from t
  where not exists (select 1 from r where r.doc_id = t.doc_id and t.i >= r.start + r.period and t.i < r.start + r.length) group by doc_id
)
select d.doc_id, coalesce(n_runs, 0)::bigint as n_runs, m.start::bigint as start, m.length::bigint as length, m.period::bigint as period,
  (1000 * m.length // m.period)::bigint as exponent_milli, sha256(coalesce(runs, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from d left join b using (doc_id) left join m using (doc_id) left join k using (doc_id)
""",
)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic.with_runs(_with_repeats(table(spark, sf, "documents"))).select("doc_id", "periodic.runs", "periodic.collapsed")
    stronger = "if(r.length * best.period > best.length * r.period, r, best)"  # runs come by start, then period
    found = found.withColumn("best", F.expr(f"if(size(runs) > 0, aggregate(runs, runs[0], (best, r) -> {stronger}), null)"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@_query(
    "op13_hard_negatives",
    """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double) for x in embedding] as v, row_number() over () as row
  from embeddings where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), s as materialized (
  select a.row as a, a.vec_id as anchor_id, b.row as b, b.vec_id, a.label = b.label as same, case when len(a.v) = 0 then 0 else list_inner_product(a.v, b.v) end::bigint as score
  from v a join v b on len(a.v) = len(b.v) where a.vec_id % 100 = 0
), p as (
  select a, anchor_id, b as positive, vec_id as positive_id, score as positive_score from s where same and a <> b
  qualify row_number() over (partition by a order by score desc, vec_id nulls last, b) <= 5
)
select p.anchor_id, positive_id, row_number() over (partition by a, positive order by score desc, vec_id nulls last, b)::int as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s using (a) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
""",
)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)
