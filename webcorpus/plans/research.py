"""Queries: structured extraction, research evidence and research memory."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import fixed, html as H, text as X, urls as U
from ..operators import evidence as V, extraction as Ex, memory as M
from ..operators.templates import REGISTRY, get_template, json_schema, json_type
from . import fixtures as fx, sqltext as q
from .registry import query

# ---- pages and prompts -------------------------------------------------------------------

_PAGES = "p AS (SELECT conv_id AS job_id, turn + 1 AS position, 'http://c/' || conv_id || '/' || turn AS url, role AS title, repeat(text, 200) AS markdown FROM conversations)"


def _job_pages(t) -> DataFrame:
    """Conversations as pages of a job, each turn long enough to meet the caps."""
    return t("conversations").select(
        F.col("conv_id").alias("job_id"), (F.col("turn") + 1).alias("position"),
        F.concat(F.lit("http://c/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("url"),
        F.col("role").alias("title"), F.repeat("text", F.lit(200)).alias("markdown"))


_BUDGET = f"""WITH {_PAGES}, m AS (SELECT *, chr(10) || '---' || chr(10) || '\U0001F4C4 Page ' || position || ': ' || title || chr(10) || '\U0001F517 URL: ' || url || chr(10) || '---' || chr(10) AS mk, substr(markdown, 1, 50000) AS tx FROM p),
  s AS (SELECT *, sum(length(mk) + length(tx)) OVER w AS cum FROM m WINDOW w AS (PARTITION BY job_id ORDER BY position)),
  o AS (SELECT *, sum((cum > 120000)::INT) OVER w AS overs FROM s WINDOW w AS (PARTITION BY job_id ORDER BY position)),
  c AS (SELECT *, CASE WHEN cum > 120000 AND overs = 1 THEN 120000 - (cum - length(mk) - length(tx)) - length(mk) - 100 END AS room FROM o),
  d AS (SELECT *, max(room) OVER w AS cut, sum(CASE WHEN overs > 1 THEN length(mk) + length(tx) ELSE 0 END) OVER w AS after FROM c WINDOW w AS (PARTITION BY job_id ORDER BY position)),
  b AS (SELECT job_id, position, url, mk || CASE WHEN overs = 0 THEN tx WHEN overs = 1 AND room > 500 THEN substr(tx, 1, room::BIGINT) WHEN overs > 1 AND cut > 500 AND after <= 100 THEN tx END AS chunk FROM d)"""


@query("l1_page_budget", sql=_BUDGET + " SELECT job_id, position, url, length(chunk) AS chars, sha256(chunk) AS h FROM b WHERE chunk IS NOT NULL")
def _(t):
    return Ex.page_budget(_job_pages(t)).select("job_id", "position", "url", "chars", F.sha2("chunk", 256).alias("h"))


@query("l1_concatenate", sql=_BUDGET + " SELECT job_id, length(string_agg(chunk, '' ORDER BY position)) AS chars, sha256(string_agg(chunk, '' ORDER BY position)) AS h FROM b WHERE chunk IS NOT NULL GROUP BY 1")
def _(t):
    c = Ex.concatenate(Ex.page_budget(_job_pages(t)))
    return c.select("job_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("h"))


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _prompt_text(template, rules) -> str:
    schema = "\nSCHEMA (valid JSON of exactly this shape):\n```json\n" + json.dumps(json_schema(template.schema), indent=2) + "\n```\n"
    guide = "\nFIELD GUIDE:\n" + "".join(f"  - {k}: {v}\n" for k, v in template.guide.items())
    return schema + guide + "\nRULES:\n" + "".join(f"  {i}. {r}\n" for i, r in enumerate(rules, 1))


@query("l2_prompts")
def _(t):
    docs = t("documents").select("doc_id", "text", F.array(F.struct(F.col("source").alias("title"), F.concat(F.lit("http://"), "source").alias("url"))).alias("s"))
    p = Ex.prompts(docs, get_template("product"), F.lit("list the products"), sources=F.col("s"), examples=[{"product_name": "x", "price": "$1"}])
    return p.select("doc_id", F.length("prompt").alias("chars"), F.sha2("prompt", 256).alias("h"))


@query("l2_prompts_text", sql=r"""SELECT doc_id, 'Extract the following information from web page content:' || chr(10) || chr(10) || 'Task: summarise ' || source || chr(10) || chr(10) || 'RULES:' || chr(10)
  || '  1. Answer in plain text.' || chr(10) || '  2. Use no JSON.' || chr(10) || '  3. Add nothing that the page does not state.' || chr(10) || chr(10) || repeat('=', 60) || chr(10) || text || chr(10) || repeat('=', 60) || chr(10) AS prompt FROM documents""")
def _(t):
    p = Ex.prompts(t("documents"), None, F.concat(F.lit("summarise "), "source"), output_format="text")
    return p.select("doc_id", "prompt")


@query("l3_resolve_template", sql=f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'own' WHEN t = 'product' THEN {_lit(REGISTRY['product'].task)} WHEN t = 'review' THEN {_lit(REGISTRY['review'].task)} END AS system,
  CASE WHEN t = 'review' THEN 'list' ELSE 'concat' END AS merge, p_partkey % 5 = 0 OR t IS NOT NULL AS has_schema FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'product' WHEN 1 THEN 'review' END AS t FROM part)""")
def _(t):
    k = F.col("p_partkey")
    jobs = t("part").select(k.alias("id"), F.when(k % 3 == 0, "product").when(k % 3 == 1, "review").alias("template"),
                            F.when(k % 5 == 0, '{"type":"object"}').alias("schema"), F.when(k % 4 == 0, "own").otherwise("").alias("system_prompt"))
    return Ex.resolve_template(jobs).select("id", F.col("effective_system").alias("system"), "merge", F.col("effective_schema").isNotNull().alias("has_schema"))


# ---- answers -----------------------------------------------------------------------------

_ANSWER = """('{"product_name": "' || p_name || '", "brand": "' || p_brand || '", "price": ' || CASE p_partkey % 4 WHEN 0 THEN 'null' WHEN 1 THEN '9.5' ELSE '"$' || p_size || '"' END
  || ', "rating": ' || CASE p_partkey % 3 WHEN 0 THEN '"bad"' ELSE '4.5' END || ', "features": ["a", ' || CASE p_partkey % 5 WHEN 0 THEN '7' ELSE '"b"' END || '], "review_count": ' || CASE p_partkey % 7 WHEN 0 THEN 'true' WHEN 1 THEN '[]' ELSE p_size::VARCHAR END || '}')"""


def _answer():
    k = F.col("p_partkey")
    return F.concat(
        F.lit('{"product_name": "'), "p_name", F.lit('", "brand": "'), "p_brand", F.lit('", "price": '),
        F.when(k % 4 == 0, "null").when(k % 4 == 1, "9.5").otherwise(F.concat(F.lit('"$'), F.col("p_size").cast("string"), F.lit('"'))),
        F.lit(', "rating": '), F.when(k % 3 == 0, '"bad"').otherwise("4.5"), F.lit(', "features": ["a", '), F.when(k % 5 == 0, "7").otherwise('"b"'),
        F.lit('], "review_count": '), F.when(k % 7 == 0, "true").when(k % 7 == 1, "[]").otherwise(F.col("p_size").cast("string")), F.lit("}"))


_FORMS = """CASE p_partkey % 6 WHEN 0 THEN a WHEN 1 THEN '```json' || chr(10) || a || chr(10) || '```' WHEN 2 THEN 'Here: ' || a || ' done}' WHEN 3 THEN replace(a, '}', ', }') WHEN 4 THEN 'no json at all' ELSE '  ' END"""


def _forms():
    k, a = F.col("p_partkey") % 6, F.col("a")
    return (F.when(k == 0, a).when(k == 1, F.concat(F.lit("```json\n"), a, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here: "), a, F.lit(" done}")))
            .when(k == 3, F.replace(a, F.lit("}"), F.lit(", }"))).when(k == 4, "no json at all").otherwise("  "))


@query("l4_strip_fences", sql=f"SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 1 THEN a ELSE trim({_FORMS}) END AS cleaned FROM (SELECT p_partkey, {_ANSWER} AS a FROM part)")
def _(t):
    return t("part").select("p_partkey", _answer().alias("a")).select(F.col("p_partkey").alias("id"), Ex.strip_fences(_forms()).alias("cleaned"))


@query("l5_parse_answer", sql=f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 6 <= 2 THEN a WHEN p_partkey % 6 = 3 THEN '{{"items":["a", ' || CASE p_partkey % 5 WHEN 0 THEN '7' ELSE '"b"' END || ']}}' WHEN p_partkey % 6 = 4 THEN '{{"raw_response":"no json at all","parse_error":true}}' ELSE '{{"raw_response":"","parse_error":true,"error":"Empty response"}}' END AS data
  FROM (SELECT p_partkey, {_ANSWER} AS a FROM part)""")
def _(t):
    return t("part").select("p_partkey", _answer().alias("a")).select(F.col("p_partkey").alias("id"), Ex.parse_answer(_forms()).alias("data"))


@query("l6_first_object", sql=f"SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE '{{\"x\": {{}}, \"y\": ' || a || '}}' END AS object FROM (SELECT p_partkey, {_ANSWER} AS a FROM part)")
def _(t):
    a, k = F.col("a"), F.col("p_partkey") % 3
    nested = F.concat(F.lit('{"x": {}, "y": '), a)
    text = F.when(k == 0, F.concat(F.lit("note "), nested, F.lit("} and {more}"))).when(k == 1, F.concat(nested, F.lit("}"))).otherwise(F.concat(F.lit("open "), nested))
    return t("part").select("p_partkey", _answer().alias("a")).select(F.col("p_partkey").alias("id"), Ex.first_object(text).alias("object"))


@query("l7_repair_json", sql=f"SELECT p_partkey AS id, replace(a, ': \"', ': \"x\\n') AS fixed FROM (SELECT p_partkey, '{{\"b\": \"' || p_brand || '\", \"c\": [1, 2]}}' AS a FROM part)")
def _(t):
    broken = F.concat(F.lit('{"b": "x\n'), "p_brand", F.lit('", /* note */"c": [1, 2, ],}'))
    return t("part").select(F.col("p_partkey").alias("id"), Ex.repair(broken).alias("fixed"))


_ERRORS = f"""x AS (SELECT p_partkey AS id, {_ANSWER} AS a, list_filter([CASE WHEN p_partkey % 4 = 0 THEN 'Missing required field: ''price''' END, CASE WHEN p_partkey % 4 = 1 THEN 'Field ''price'' has type float, expected string' END,
  CASE WHEN p_partkey % 3 = 0 THEN 'Field ''rating'' has type str, expected number' END, CASE WHEN p_partkey % 7 = 1 THEN 'Field ''review_count'' has type list, expected integer' END,
  CASE WHEN p_partkey % 5 = 0 THEN 'Field ''features[1]'' has type int, expected string' END], lambda e: e IS NOT NULL) AS errors, p_partkey % 4 <> 0 AS priced FROM part),
  y AS (SELECT *, greatest(least((CASE WHEN priced THEN 2 ELSE 1 END) / 2.0::DOUBLE * 0.75::DOUBLE + 4 / 13.0::DOUBLE * 0.15::DOUBLE - least(len(errors) * 0.12::DOUBLE, 0.5::DOUBLE), 1.0::DOUBLE), 0.0::DOUBLE) AS confidence FROM x)"""


def _scored(t, typed=False):
    return Ex.score_answers(t("part").select(F.col("p_partkey").alias("id"), _answer().alias("answer")), get_template("product"), typed=typed)


@query("l8_validation_errors", sql=f"WITH {_ERRORS} SELECT id, array_to_string(errors, '; ') AS errors FROM y")
def _(t):
    return _scored(t).select("id", F.array_join("errors", "; ").alias("errors"))


@query("l9_schema_confidence", sql=f"WITH {_ERRORS} SELECT id, round(confidence, 6) AS confidence FROM y")
def _(t):
    return _scored(t).select("id", F.round("confidence", 6).alias("confidence"))


@query("l10_typed_confidence", sql=f"WITH {_ERRORS} SELECT id, round(greatest(0.0::DOUBLE, 1 - len(errors) * 0.15::DOUBLE), 6) AS confidence FROM y")
def _(t):
    return _scored(t, typed=True).select("id", F.round("confidence", 6).alias("confidence"))


_ATT = """a AS (SELECT event_id // 3 AS doc_id, event_id % 3 + 1 AS attempt, CASE WHEN event_type <> 'error' THEN 'd' || event_id END AS data, CASE WHEN event_type <> 'error' THEN (user_id % 21) / 20.0::DOUBLE END AS confidence,
  CASE WHEN event_type = 'click' THEN ['bad'] ELSE []::VARCHAR[] END AS errors, CASE WHEN event_type = 'error' THEN 'boom ' || user_id END AS error FROM events),
  g AS (SELECT *, data IS NOT NULL AND ((confidence >= 0.75 AND len(errors) = 0) OR confidence >= 0.85) AS good FROM a)"""


@query("l11_select_attempts", sql=f"""WITH {_ATT}, k AS (SELECT doc_id, min(attempt) FILTER (good) AS first_good, count(data) AS n, max_by(error, attempt) AS err, arg_max(attempt, confidence * 1000 - attempt) FILTER (data IS NOT NULL AND confidence > 0) AS best FROM g GROUP BY 1)
  SELECT k.doc_id, coalesce(g.data, '{{"error":"All extraction attempts failed"}}') AS data, coalesce(g.confidence, 0.0::DOUBLE) AS confidence, coalesce(first_good, 3) AS attempts, coalesce(array_to_string(g.errors, ','), '') AS errors,
    CASE WHEN n = 0 THEN 'All 3 extraction attempts failed. Last error: ' || err END AS error FROM k LEFT JOIN g ON g.doc_id = k.doc_id AND g.attempt = coalesce(first_good, best)""")
def _(t):
    bad = F.col("event_type") == "error"
    a = t("events").select(
        F.floor(F.col("event_id") / 3).alias("doc_id"), (F.col("event_id") % 3 + 1).alias("attempt"),
        F.when(~bad, F.concat(F.lit("d"), F.col("event_id").cast("string"))).alias("data"), F.when(~bad, (F.col("user_id") % 21) / 20.0).alias("confidence"),
        F.when(F.col("event_type") == "click", F.array(F.lit("bad"))).otherwise(F.array().cast("array<string>")).alias("errors"),
        F.when(bad, F.concat(F.lit("boom "), F.col("user_id").cast("string"))).alias("error"))
    return Ex.select_attempts(a).withColumn("errors", F.array_join("errors", ","))


@query("l12_field_presence", sql="""SELECT field, count(*) AS n, sum(present::INT)::BIGINT AS present, round(avg(present::INT), 6) AS rate FROM (SELECT unnest(['product_name', 'brand', 'price', 'rating', 'features', 'review_count']) AS field,
  unnest([p_name <> '', p_brand <> '', p_partkey % 4 <> 0, true, true, p_partkey % 7 <> 1]) AS present FROM part) GROUP BY 1""")
def _(t):
    return Ex.field_presence(_scored(t)).withColumn("rate", F.round("rate", 6))


@query("l13_success_flag", sql=f"WITH {_ERRORS} SELECT id, confidence >= 0.3 AS success FROM y")
def _(t):
    return _scored(t).select("id", Ex.success("confidence").alias("success"))


@query("l14_source_list", sql=f"WITH {_PAGES} SELECT job_id, url, title, length(markdown) AS length FROM p WHERE markdown <> ''")
def _(t):
    return Ex.source_list(_job_pages(t))


# every template scores the same kind of record, made of these fields
_FIELDS = {"name": "p_name", "title": "p_name", "product_name": "p_name", "job_title": "p_name", "company": "p_brand", "price": "p_type", "address": "p_brand", "event_name": "p_name",
           "content": "p_type", "recipe_name": "p_name", "url": "p_brand", "description": "p_type", "authors": "p_name", "year_built": "p_brand"}
_RAW = {"overall_rating": "4.5", "ingredients": '["a", "b"]', "instructions": '"stir"', "faq_items": '[{"question": "q"}, {"question": "q", "answer": 1}]', "tags": '["x", 1]',
        "reviews": '[{"author": "a", "verified": "yes"}, 3]', "word_count": "true", "nutrition": "[]", "bedrooms": "2.5", "specifications": "{}"}
_RECORD = "('{' || " + " || ', ' || ".join([f"'\"{k}\": \"' || {v} || '\"'" for k, v in _FIELDS.items()] + [_lit(f'"{k}": {v}') for k, v in _RAW.items()]) + " || CASE WHEN p_partkey % 2 = 0 THEN ', \"summary\": null' ELSE ', \"summary\": \"s\"' END || '}')"


def _record():
    parts = [F.concat(F.lit(f'"{k}": "'), F.col(v), F.lit('"')) for k, v in _FIELDS.items()] + [F.lit(f'"{k}": {v}') for k, v in _RAW.items()]
    body = F.concat_ws(", ", *parts)
    return F.concat(F.lit("{"), body, F.when(F.col("p_partkey") % 2 == 0, ', "summary": null').otherwise(', "summary": "s"'), F.lit("}"))


_SQL_TYPES = {"string": ["VARCHAR"], "integer": ["BIGINT", "UBIGINT", "BOOLEAN"], "number": ["BIGINT", "UBIGINT", "DOUBLE", "BOOLEAN"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"]}


def _sql_wrong(expr: str, dt) -> str:
    names = ", ".join(f"'{n}'" for n in _SQL_TYPES[json_type(dt)])
    return f"(CASE WHEN coalesce(json_type({expr}), 'NULL') NOT IN ('NULL', {names}) THEN 1 ELSE 0 END)"


def _sql_errors(expr: str, dt, depth: int = 0) -> str:
    """Number of errors of a JSON value against a type, members included."""
    total = [_sql_wrong(expr, dt)]
    if isinstance(dt, T.ArrayType):
        v = f"x{depth}"
        inner = _sql_errors(v, dt.elementType, depth + 1)
        items = f"CASE WHEN json_type({expr}) = 'ARRAY' THEN json_extract({expr}, '$[*]') ELSE [] END"
        total.append(f"coalesce(list_sum(list_transform({items}, lambda {v}: {inner})), 0)")
    if isinstance(dt, T.StructType):
        need = [f"(CASE WHEN coalesce(json_type(json_extract({expr}, '$.{f.name}')), 'NULL') = 'NULL' THEN 1 ELSE 0 END)" for f in dt.fields if not f.nullable]
        members = [_sql_errors(f"json_extract({expr}, '$.{f.name}')", f.dataType, depth + 1) for f in dt.fields]
        total.append(f"(CASE WHEN json_type({expr}) = 'OBJECT' THEN {' + '.join(need + members)} ELSE 0 END)")
    return "(" + " + ".join(total) + ")"


def _template_sql(name: str) -> str:
    st = REGISTRY[name].schema

    def filled(fields):
        return " + ".join(f"(CASE WHEN coalesce(json_type(json_extract(r, '$.{f.name}')), 'NULL') <> 'NULL' THEN 1 ELSE 0 END)" for f in fields) or "0"

    need, free = [f for f in st.fields if not f.nullable], [f for f in st.fields if f.nullable]
    missing = f"({len(need)} - ({filled(need)}))"
    errors = " + ".join([missing] + [_sql_errors(f"json_extract(r, '$.{f.name}')", f.dataType) for f in st.fields])
    return f"""WITH a AS (SELECT p_partkey AS id, {_RECORD}::JSON AS r FROM part), b AS (SELECT id, ({filled(need)}) / {len(need)}.0::DOUBLE AS req, ({filled(free)}) / {max(len(free), 1)}.0::DOUBLE AS opt, ({errors})::BIGINT AS errors FROM a)
  SELECT id, errors, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, req * 0.75::DOUBLE + opt * 0.15::DOUBLE - least(errors * 0.12::DOUBLE, 0.5::DOUBLE))), 6) AS confidence FROM b"""


def _register_templates():
    names = ["product", "article", "job_posting", "real_estate", "person", "event", "review", "faq", "recipe", "research_paper"]
    for i, name in enumerate(names):
        def run(t, name=name):
            s = Ex.score_answers(t("part").select(F.col("p_partkey").alias("id"), _record().alias("answer")), get_template(name))
            return s.select("id", F.size("errors").alias("errors"), F.round("confidence", 6).alias("confidence"))

        query(f"l{15 + i}_template_{name}", sql=_template_sql(name))(run)


_register_templates()


def _merged(t, how):
    pages = _scored(t).select(F.floor(F.col("id") / 4).alias("doc_id"), (F.col("id") % 4).alias("page"), "data")
    return Ex.merge_pages(pages, how)


@query("l25_merge_first", sql="""WITH f AS (SELECT p_partkey // 4 AS doc_id, p_partkey % 4 AS page, unnest(['product_name', 'brand', 'price', 'rating', 'features', 'review_count']) AS field,
    unnest([p_name, p_brand, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '9.5' ELSE '$' || p_size END, CASE WHEN p_partkey % 3 = 0 THEN 'bad' ELSE '4.5' END, '["a",' || CASE WHEN p_partkey % 5 = 0 THEN '7' ELSE '"b"' END || ']',
      CASE p_partkey % 7 WHEN 0 THEN 'true' WHEN 1 THEN NULL ELSE p_size::VARCHAR END]) AS value FROM part)
  SELECT doc_id, field, min_by(value, page) AS value FROM f WHERE value IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return _merged(t, "merge")


@query("l25_merge_concat", sql="""SELECT p_partkey // 4 AS doc_id, p_partkey % 4 AS page, unnest([0, 1])::BIGINT AS pos, unnest(['a', CASE WHEN p_partkey % 5 = 0 THEN '7' ELSE 'b' END]) AS item FROM part""")
def _(t):
    return _merged(t, "concat").filter("field = 'features'").select("doc_id", "page", "pos", "item")


@query("p1_registered_template", sql="SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'Missing required field: ''maker''' ELSE '' END AS errors FROM part")
def _(t):
    from ..operators.templates import Template

    own = Template("own", T.StructType([T.StructField("maker", T.StringType(), False), T.StructField("size", T.LongType())]))
    a = F.concat(F.lit("{"), F.when(F.col("p_partkey") % 2 == 1, F.concat(F.lit('"maker": "'), "p_brand", F.lit('", '))).otherwise(""), F.lit('"size": '), F.col("p_size").cast("string"), F.lit("}"))
    return t("part").select(F.col("p_partkey").alias("id"), F.array_join(Ex.validation_errors(a, own), "; ").alias("errors"))


@query("p4_own_record_type", sql="""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'Missing required field: ' || chr(39) || 'maker' || chr(39) ELSE '' END AS errors,
  round(CASE WHEN p_partkey % 2 = 0 THEN 0.85 ELSE 1.0 END::DOUBLE, 6) AS confidence FROM part""")
def _(t):
    # a record type of the user's own scores by its errors alone
    from ..operators.templates import Template

    own = Template("own", T.StructType([T.StructField("maker", T.StringType(), False), T.StructField("size", T.LongType())]))
    a = F.concat(F.lit("{"), F.when(F.col("p_partkey") % 2 == 1, F.concat(F.lit('"maker": "'), "p_brand", F.lit('", '))).otherwise(""), F.lit('"size": '), F.col("p_size").cast("string"), F.lit("}"))
    scored = Ex.score_answers(t("part").select(F.col("p_partkey").alias("id"), a.alias("answer")), own, typed=True)
    return scored.select("id", F.array_join("errors", "; ").alias("errors"), F.round("confidence", 6).alias("confidence"))


# ---- evidence ----------------------------------------------------------------------------

@query("m1_sub_questions", sql="""SELECT text AS topic, unnest(['question', 'question', 'question', 'question', 'question', 'query', 'query', 'query', 'query']) AS kind, unnest([1, 2, 3, 4, 5, 1, 2, 3, 4])::BIGINT AS pos,
  unnest(['What is ' || text || '?', 'History of ' || text, 'Key facts about ' || text, 'Pros and cons of ' || text, 'How does ' || text || ' work?', text, text || ' definition', text || ' explained', text || ' guide']) AS text FROM benchmark""")
def _(t):
    return V.sub_questions(t("benchmark"), "text")


@query("m2_keywords", sql=r"""SELECT item_id, array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: length(w) > 4)[1:3], ' ') AS words FROM benchmark""")
def _(t):
    return t("benchmark").select("item_id", F.array_join(X.long_words("text"), " ").alias("words"))


def _pairs(t) -> DataFrame:
    """Each document as the page found for one question, in turn."""
    b = t("benchmark")
    n = b.agg(F.count("*")).scalar()
    d = t("documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("content"), (F.col("doc_id") % n).alias("item_id"),
                              F.concat(F.lit("https://"), "source", F.lit(".org/"), F.col("doc_id").cast("string")).alias("url"))
    return d.join(b.select("item_id", F.col("text").alias("question")), "item_id")


_WORDS = r"list_distinct(list_filter(string_split_regex(lower({0}), '\s+'), lambda w: w <> ''))"
_PAIRS = f"""pairs AS (SELECT d.doc_id, b.item_id, b.text AS question, d.text AS content, d.source AS title, 'https://' || d.source || '.org/' || d.doc_id AS url FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
  sc AS (SELECT *, {_WORDS.format('question')} AS ws, lower(content) AS body FROM pairs),
  rel AS (SELECT *, len(list_filter(ws, lambda w: contains(body, w))) / len(ws)::DOUBLE AS share FROM sc),
  rated AS (SELECT *, least(1.0::DOUBLE, CASE WHEN contains(body, lower(question)) THEN least(1.0::DOUBLE, share + 0.3::DOUBLE) ELSE share END + least(0.1::DOUBLE, length(content) / 50000.0::DOUBLE)) AS relevance,
    list_filter(list_transform(string_split_regex(content, '[.!?]+'), lambda s: {q.strip('s')}), lambda s: length(s) > 30) AS ss FROM rel),
  quoted AS (SELECT *, CASE WHEN content = '' THEN '' ELSE substr(coalesce(list_sort(list_transform(ss, lambda s, i: {{'n': -len(list_intersect(ws, {_WORDS.format('s')})), 'i': i, 's': s}}))[1].s, content), 1, 500) END AS quote FROM rated)"""


@query("m3_relevance", sql=f"WITH {_PAIRS} SELECT doc_id, item_id, round(relevance, 6) AS relevance FROM rated")
def _(t):
    return _pairs(t).select("doc_id", "item_id", F.round(X.relevance("content", "question"), 6).alias("relevance"))


@query("m4_word_overlap", sql=f"WITH {_PAIRS} SELECT doc_id, item_id, round(CASE WHEN content = '' THEN 0.0::DOUBLE ELSE least(share, 1.0::DOUBLE) END, 6) AS relevance FROM rel")
def _(t):
    return _pairs(t).select("doc_id", "item_id", F.round(X.word_overlap("content", "question"), 6).alias("relevance"))


@query("m5_relevant_quote", sql=f"WITH {_PAIRS} SELECT doc_id, quote FROM quoted")
def _(t):
    return _pairs(t).select("doc_id", X.relevant_quote("content", "question").alias("quote"))


@query("m6_first_paragraph", sql=f"""SELECT doc_id, substr(coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda s: {q.strip('s')}), lambda s: length(s) > 50)[1], text), 1, 300) AS summary FROM documents""")
def _(t):
    return t("documents").select("doc_id", X.first_paragraph("text").alias("summary"))


@query("m7_citations", sql=f"WITH {_PAIRS} SELECT doc_id, item_id, url, title, {q.domain('url')} AS domain, quote, round(relevance, 6) AS relevance, '' AS timestamp FROM quoted")
def _(t):
    c = V.citations(_pairs(t))
    return c.select("doc_id", "item_id", "url", "title", "domain", "quote", F.round("relevance", 6).alias("relevance"), "timestamp")


@query("m8_best_sources", sql=f"WITH {_PAIRS} SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(relevance, 9) DESC, url) AS rank FROM rated QUALIFY rank <= 5")
def _(t):
    s = _pairs(t).select("item_id", "doc_id", "url", F.round(X.relevance("content", "question"), 9).alias("relevance"))
    return V.best_sources(s, "item_id").select("item_id", "doc_id", "rank")


@query("m9_findings", sql="""SELECT p_partkey AS id, unnest([0, 1])::BIGINT AS pos, unnest([CASE WHEN p_partkey % 3 = 0 THEN 'general' ELSE p_brand END, 'general']) AS topic, unnest([p_name || ' is ' || p_type, '']) AS claim,
  unnest([CASE WHEN p_partkey % 2 = 0 THEN 0.4 ELSE 0.7 END, 0.7])::DOUBLE AS confidence, unnest([p_partkey % 2 = 0, false]) AS needs_verification FROM part""")
def _(t):
    k = F.col("p_partkey")
    topic = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(', "topic": "'), "p_brand", F.lit('"')))
    a = F.concat(F.lit('{"claims": [{"claim": "'), "p_name", F.lit(" is "), "p_type", F.lit('"'), topic, F.when(k % 2 == 0, ', "needs_verification": true').otherwise(""), F.lit("}, {}]}"))
    return V.findings_from_answers(t("part").select(k.alias("id"), a.alias("answer")))


_FINDINGS = "f AS (SELECT 'r' || p_size AS report_id, p_partkey AS seq, p_brand AS topic, p_name || ' costs ' || p_type || CASE WHEN p_partkey % 2 = 0 THEN ' today' ELSE '' END AS claim, (p_partkey % 11) / 10.0::DOUBLE AS confidence FROM part)"
_CITES = f"c AS (SELECT 'r' || (doc_id % 60) AS report_id, doc_id AS seq, 'https://' || source || '.org/' || doc_id AS url, source AS title, source || '.org' AS domain, substr(text, 1, 300) AS quote, (n_chars % 101) / 100.0::DOUBLE AS relevance, text FROM documents)"


def _findings(t) -> DataFrame:
    k = F.col("p_partkey")
    return t("part").select(
        F.concat(F.lit("r"), F.col("p_size").cast("string")).alias("report_id"), k.alias("seq"), F.col("p_brand").alias("topic"),
        F.concat("p_name", F.lit(" costs "), "p_type", F.when(k % 2 == 0, " today").otherwise("")).alias("claim"), ((k % 11) / 10.0).alias("confidence"))


def _cites(t) -> DataFrame:
    d = F.col("doc_id")
    return t("documents").select(
        F.concat(F.lit("r"), (d % 60).cast("string")).alias("report_id"), d.alias("seq"), F.concat(F.lit("https://"), "source", F.lit(".org/"), d.cast("string")).alias("url"),
        F.col("source").alias("title"), F.concat("source", F.lit(".org")).alias("domain"), F.substring("text", 1, 300).alias("quote"), ((F.col("n_chars") % 101) / 100.0).alias("relevance"), "text")


def _reports(t) -> DataFrame:
    return t("part").select(F.concat(F.lit("r"), F.col("p_size").cast("string")).alias("report_id"), F.concat(F.lit("topic "), F.col("p_size").cast("string")).alias("query")).distinct()


_REPORTS = "r AS (SELECT DISTINCT 'r' || p_size AS report_id, 'topic ' || p_size AS query FROM part)"


@query("m10_facts", sql=f"WITH {_FINDINGS} SELECT report_id, claim, max(confidence) AS confidence FROM f GROUP BY 1, 2")
def _(t):
    return V.facts(_findings(t), ["report_id"])


@query("m10_sources_per_domain", sql=f"WITH {_CITES} SELECT report_id, domain, count(*) AS citations FROM c GROUP BY 1, 2")
def _(t):
    return V.sources_per_domain(_cites(t), ["report_id"])


@query("m11_average_confidence", sql=f"WITH {_FINDINGS}, m AS (SELECT report_id, claim, max(confidence) AS confidence FROM f GROUP BY 1, 2) SELECT report_id, round(avg(confidence), 6) AS confidence FROM m GROUP BY 1")
def _(t):
    return V.average_confidence(V.facts(_findings(t), ["report_id"]), ["report_id"]).withColumn("confidence", F.round("confidence", 6))


@query("m12_topic_groups", sql=f"WITH {_FINDINGS} SELECT report_id, topic, count(*) AS findings, max(confidence) AS best, round(avg(confidence), 6) AS mean FROM f GROUP BY 1, 2")
def _(t):
    return V.topic_groups(_findings(t), ["report_id"]).withColumn("mean", F.round("mean", 6))


@query("m12_ordered_findings", sql=f"WITH {_FINDINGS}, m AS (SELECT report_id, topic, seq AS first_seq FROM f QUALIFY row_number() OVER (PARTITION BY report_id, topic ORDER BY confidence DESC, seq) = 1) SELECT f.report_id, f.topic, f.seq, m.first_seq FROM f JOIN m USING (report_id, topic)")
def _(t):
    return V.ordered_findings(_findings(t), ["report_id"]).select("report_id", "topic", "seq", F.col("topic_order.s").alias("first_seq"))


@query("m13_knowledge_graph", sql=rf"""WITH {_FINDINGS}, w AS (SELECT report_id, topic, seq, list_filter(string_split_regex(claim, '\s+'), lambda x: x <> '')[1:5] AS ws FROM f)
  SELECT report_id, topic, seq, pos, lower(word) AS word FROM (SELECT report_id, topic, seq, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM w) WHERE length(word) > 4 AND lower(word) <> lower(topic)""")
def _(t):
    return V.knowledge_graph(_findings(t), ["report_id"]).select("report_id", "topic", "seq", "pos", "word")


@query("m14_confidence_label", sql=f"WITH {_FINDINGS} SELECT seq, CASE WHEN confidence >= 0.8 THEN 'HIGH CONFIDENCE' WHEN confidence >= 0.6 THEN 'MEDIUM CONFIDENCE' WHEN confidence >= 0.4 THEN 'LOW CONFIDENCE' ELSE 'UNVERIFIED' END AS label FROM f")
def _(t):
    return _findings(t).select("seq", X.confidence_label("confidence").alias("label"))


@query("m15_confidence_counts", sql=f"WITH {_FINDINGS} SELECT report_id, count(*) FILTER (confidence < 0.5) AS low, count(*) FILTER (confidence >= 0.7) AS high, count(*) AS total FROM f GROUP BY 1")
def _(t):
    return V.confidence_counts(_findings(t), ["report_id"])


def _questions(t) -> DataFrame:
    k = F.col("p_partkey")
    text = (F.when(k % 3 == 0, F.concat("p_name", F.lit(" COSTS"))).when(k % 3 == 1, F.concat(F.lit("Why "), "p_name", F.lit(" costs "), "p_type", F.lit(" now?"))).otherwise(F.concat(F.lit("what of "), "p_type")))
    return t("part").select(F.concat(F.lit("r"), (F.col("p_size") % 60).cast("string")).alias("report_id"), k.alias("seq"), text.alias("question"))


@query("m16_unanswered", sql=f"""WITH {_FINDINGS}, qs AS (SELECT 'r' || (p_size % 60) AS report_id, p_partkey AS seq, CASE p_partkey % 3 WHEN 0 THEN p_name || ' COSTS' WHEN 1 THEN 'Why ' || p_name || ' costs ' || p_type || ' now?' ELSE 'what of ' || p_type END AS question FROM part)
  SELECT report_id, seq, question FROM qs WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.report_id = qs.report_id AND (contains(lower(f.claim), lower(qs.question)) OR contains(lower(qs.question), lower(f.claim))))
  QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY seq) <= 10""")
def _(t):
    return V.unanswered(_questions(t), _findings(t))


@query("m17_summaries", sql=f"""WITH {_FINDINGS}, {_CITES}, {_REPORTS}, b AS (SELECT report_id, string_agg('- ' || claim, ' ' ORDER BY confidence DESC, seq) AS claims FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY confidence DESC, seq) <= 5) GROUP BY 1)
  SELECT r.report_id, 'Research on ''' || query || ''' consulted ' || (SELECT count(*) FROM c WHERE c.report_id = r.report_id) || ' sources and produced ' || (SELECT count(*) FROM f WHERE f.report_id = r.report_id) || ' findings. Top conclusions: ' || substr(claims, 1, 300) || '...' AS summary FROM r JOIN b USING (report_id)""")
def _(t):
    return V.summaries(_reports(t), _findings(t), _cites(t))


_CONTRA = "k AS (SELECT 'r' || p_size AS report_id, p_partkey AS seq, p_name AS claim_a, p_type AS claim_b FROM part WHERE p_partkey % 7 = 0)"


def _contra(t) -> DataFrame:
    return t("part").filter("p_partkey % 7 = 0").select(
        F.concat(F.lit("r"), F.col("p_size").cast("string")).alias("report_id"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("claim_a"), F.col("p_type").alias("claim_b"))


@query("m18_report_confidence", sql=f"""WITH {_CITES}, {_CONTRA}, t5 AS (SELECT report_id, avg(relevance) AS rel FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY relevance DESC) <= 5) GROUP BY 1)
  SELECT n.report_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, least(n / 10.0::DOUBLE, 1.0::DOUBLE) * 0.4::DOUBLE + rel * 0.3::DOUBLE + 0.3::DOUBLE - least((SELECT count(*) FROM k WHERE k.report_id = n.report_id) * 0.1::DOUBLE, 0.3::DOUBLE))), 6) AS confidence
  FROM (SELECT report_id, count(*) AS n FROM c GROUP BY 1) n JOIN t5 USING (report_id)""")
def _(t):
    return V.report_confidence(_cites(t), _contra(t)).withColumn("confidence", F.round("confidence", 6))


@query("m19_report_bodies")
def _(t):
    b = V.report_bodies(_reports(t), _findings(t), _cites(t), F.lit("2024-01-30 00:00:00").cast("timestamp"), "brief")
    return b.select("report_id", "words", F.length("body").alias("chars"))


@query("m20_contradictions", sql=f"WITH {_CONTRA} SELECT report_id, seq, 'Contradiction detected: ''' || claim_a || ''' vs ''' || claim_b || '''' AS warning FROM k QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY seq) <= 3")
def _(t):
    return V.contradiction_warnings(_contra(t))


@query("m21_citation_order", sql=f"WITH {_CITES} SELECT report_id, seq, row_number() OVER (PARTITION BY report_id ORDER BY relevance DESC, url) AS rank FROM c QUALIFY rank <= 20")
def _(t):
    return V.best_sources(_cites(t), "report_id", k=20).select("report_id", "seq", "rank")


@query("m22_synthesis_context", sql=f"""WITH {_CITES}, b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY relevance DESC, url) <= 10)
  SELECT report_id, string_agg('## Source: ' || title || chr(10) || 'URL: ' || url || chr(10) || 'Summary: ' || CASE WHEN seq % 2 = 0 THEN quote ELSE substr(text, 1, 200) END || chr(10), chr(10) || chr(10) ORDER BY relevance DESC, url) AS context FROM b GROUP BY 1""")
def _(t):
    c = _cites(t).withColumn("summary", F.when(F.col("seq") % 2 == 0, F.col("quote"))).withColumnRenamed("text", "raw_content")
    return V.synthesis_context(c)


@query("m23_source_outlinks", sql=f"SELECT page_id, array_to_string({q.hrefs(q.no_code('html'))}[1:10], ' ') AS links FROM pages")
def _(t):
    return t("pages").select("page_id", F.array_join(F.slice(H.hrefs("html"), 1, 10), " ").alias("links"))


# ---- memory ------------------------------------------------------------------------------

@query("n1_chunks")
def _(t):
    return M.chunks(t("documents"), "doc_id", "text").select("doc_id", "chunk_index", "total_chunks", F.sha2("chunk", 256).alias("h"))


@query("n2_fixed_chunks", sql="""WITH d AS (SELECT doc_id, repeat(sha256(text), 1 + doc_id % 60) AS x FROM documents), s AS (SELECT doc_id, x, length(x) AS n, greatest(ceil((length(x) - 1000) / 900.0), 0)::BIGINT AS last FROM d),
  w AS (SELECT doc_id, unnest(range(0, last + 1)) AS i, x, n, last FROM s), t AS (SELECT doc_id, x, n, last, last * 900 + least(n - last * 900, 1000) - 100 AS tail FROM s)
  SELECT doc_id, i AS chunk_index, sha256(substr(x, i * 900 + 1, 1000)) AS h FROM w UNION ALL SELECT doc_id, last + 1, sha256(substr(x, tail + 1, 1000)) FROM t WHERE tail > 0 AND substr(x, tail + 1, 1000) <> substr(x, last * 900 + 1, 1000)""")
def _(t):
    d = t("documents").select("doc_id", F.repeat(F.sha2("text", 256), (1 + F.col("doc_id") % 60).cast("int")).alias("x"))
    return M.fixed_chunks(d, "doc_id", "x").select("doc_id", "chunk_index", F.sha2("chunk", 256).alias("h"))


def _items(t) -> DataFrame:
    at = F.lit("2024-01-30 00:00:00").cast("timestamp")
    f = _findings(t).withColumn("source_urls", F.array(F.concat(F.lit("http://"), "topic")))
    s = V.summaries(_reports(t), _findings(t), _cites(t)).join(_reports(t), "report_id").withColumn("findings", F.lit(1)).withColumn("citations", F.lit(2)).withColumn("confidence", F.lit(0.5))
    return M.store(None, M.finding_items(f, at), M.citation_items(_cites(t), at), M.summary_items(s, at))


_ITEMS = f"""{_FINDINGS}, {_CITES}, {_REPORTS}, items AS (SELECT 'finding_' || substr(sha256(claim), 1, 16) AS id, 'finding' AS type, min(report_id) AS report_id FROM f GROUP BY 1, 2
  UNION ALL SELECT 'cite_' || substr(sha256(url || quote), 1, 16), 'citation', min(report_id) FROM c WHERE quote <> '' GROUP BY 1, 2 UNION ALL SELECT 'report_summary_' || report_id, 'report_summary', report_id FROM r)"""


@query("n3_memory_items", sql=f"WITH {_ITEMS} SELECT id, type, report_id FROM items")
def _(t):
    return _items(t).select("id", "type", "report_id")


def _centroids(t) -> DataFrame:
    """Mean vector per label: one query vector per topic."""
    e = t("embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = e.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("embedding"))


_NEAR = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY 1, 2),
  ce AS (SELECT label, list(m ORDER BY pos) AS v FROM m GROUP BY 1), near AS (SELECT ce.label, e.vec_id, e.label AS other, list_cosine_similarity(ce.v, e.v) AS sim FROM ce, e QUALIFY row_number() OVER (PARTITION BY ce.label ORDER BY sim DESC, e.vec_id) <= 10)"""


@query("n4_nearest", sql=f"WITH {_NEAR} SELECT label::BIGINT AS label, vec_id, round(greatest(0.0::DOUBLE, sim), 6) AS relevance, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS rank FROM near")
def _(t):
    return M.nearest(t("embeddings"), _centroids(t), "vec_id", "label", n=10).withColumn("relevance", F.round("relevance", 6))


@query("n5_min_relevance", sql=f"WITH {_NEAR} SELECT label::BIGINT AS label, vec_id FROM near WHERE sim >= 0.4")
def _(t):
    return M.nearest(t("embeddings"), _centroids(t), "vec_id", "label", n=10, min_relevance=0.4).select("label", "vec_id")


@query("n6_related_topics", sql=f"WITH {_NEAR} SELECT label::BIGINT AS label, array_to_string(list_sort(list_distinct(list(other::VARCHAR))), ',') AS topics FROM near WHERE other <> label GROUP BY 1")
def _(t):
    c = _centroids(t)
    near = M.nearest(t("embeddings"), c, "vec_id", "label", n=10)
    items = t("embeddings").select("vec_id", F.col("label").cast("string").alias("topic"))
    topics = c.select("label", F.col("label").cast("string").alias("asked"))
    return M.related_topics(near, items, "vec_id", "label", topics).withColumn("topics", F.array_join("topics", ","))


@query("n7_reports", sql=f"WITH {_REPORTS} SELECT 'report_summary_' || report_id AS id, query, report_id, 0.5::DOUBLE AS confidence FROM r")
def _(t):
    return M.reports(_items(t)).select("id", "query", "report_id", "confidence")


@query("n8_delete_report", sql=f"WITH {_ITEMS} SELECT id FROM items WHERE report_id NOT IN (SELECT report_id FROM r WHERE substr(report_id, 2)::INT % 2 = 0)")
def _(t):
    gone = _reports(t).filter("cast(substr(report_id, 2) AS int) % 2 = 0")
    return M.delete_report(_items(t), gone).select("id")


@query("n9_count", sql=f"WITH {_ITEMS} SELECT count(*) AS items FROM items")
def _(t):
    return M.count(_items(t))


@query("n10_approximate_nearest")
def _(t):
    # every vector asks all of them
    e = t("embeddings")
    return M.nearest_by_cells(e, e.select(F.col("vec_id").alias("query_id"), "embedding"), "vec_id", "query_id", n=10)


# all cells probed: the exact answer, among the items of the query's own label
@query("n10_nearest_of_label", sql="""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (
    SELECT q.vec_id AS query_id, i.vec_id, list_cosine_similarity(q.v, i.v) AS sim FROM e q JOIN e i ON q.label = i.label AND i.label IS NOT NULL)
  SELECT query_id, vec_id, round(greatest(0.0::DOUBLE, sim), 6) AS relevance FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 5""")
def _(t):
    e = t("embeddings")
    asked = e.select(F.col("vec_id").alias("query_id"), "label", "embedding")
    near = M.nearest_by_cells(e, asked, "vec_id", "query_id", n=5, probes=1 << 20, where=F.col("label").isNotNull(), match=("label",))
    return near.select("query_id", "vec_id", F.round("relevance", 6).alias("relevance"))
