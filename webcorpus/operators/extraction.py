"""Structured extraction: prompts before the model call, parsing and scoring after it."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions import fixed, text as X
from ..functions.bind import let
from .segments import top_k
from .templates import REGISTRY, Template, json_schema, json_type


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- pages and prompts -------------------------------------------------------------------

def page_budget(pages: DataFrame, job="job_id", position="position", url="url", title="title", text="markdown",
                per_page: int = fixed.PAGE_CHARS, total: int = fixed.TOTAL_CHARS) -> DataFrame:
    """Part of every page that fits the budget of its job, with its marker.

    ``position`` orders the pages of a job and may have gaps. A page costs at least its marker, so only
    the first ``total / marker`` pages of a job can ever fit; the others go in a row-number filter, which
    Spark applies per task before the shuffle, so that no job's window is large.
    """
    a, b, c, d = fixed.PAGE_MARKER
    least = len(a + "1" + b + c + d)
    p = F.col(position)
    marker = F.concat(F.lit(a), p.cast("string"), F.lit(b), F.coalesce(title, F.lit("")), F.lit(c), F.col(url), F.lit(d))
    first = F.row_number().over(W.partitionBy(job).orderBy(position))
    rows = pages.withColumn("_nth", first).filter(F.col("_nth") <= total // least + 1).select(
        job, position, url, marker.alias("_m"), F.substring(text, 1, per_page).alias("_t"))
    rows = rows.withColumn("_len", F.length("_m") + F.length("_t"))
    w = W.partitionBy(job).orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum("_len").over(w))
    over = F.col("_sum") > total
    rows = rows.withColumn("_overs", F.sum(over.cast("int")).over(w))
    first_over = over & (F.col("_overs") == 1)
    room = total - (F.col("_sum") - F.col("_len")) - F.length("_m") - fixed.TRUNCATION_RESERVE
    rows = rows.withColumn("_cut", F.when(first_over, room))
    # the first page that does not fit is cut when enough room is left; very short pages
    # behind it may still use the reserve
    cut = F.max("_cut").over(w)
    after = F.sum(F.when(F.col("_overs") > 1, F.col("_len")).otherwise(0)).over(w)
    text_out = (
        F.when(~over, F.col("_t"))
        .when(first_over & (room > fixed.TRUNCATION_MIN), F.expr("substring(_t, 1, cast(_cut as int))"))
        .when((F.col("_overs") > 1) & (F.col("_room") > fixed.TRUNCATION_MIN) & (F.col("_after") <= fixed.TRUNCATION_RESERVE), F.col("_t"))
    )
    rows = rows.withColumn("_room", cut).withColumn("_after", after).withColumn("_x", text_out)
    return rows.filter(F.col("_x").isNotNull()).select(
        job, position, url, F.concat("_m", "_x").alias("chunk"), F.length(F.concat("_m", "_x")).alias("chars"))


def concatenate(budgeted: DataFrame, job="job_id", position="position") -> DataFrame:
    """Text per job; a job holds at most its character budget."""
    items = F.array_sort(F.collect_list(F.struct(position, "chunk")))
    return budgeted.groupBy(job).agg(items.alias("_i")).select(
        job, F.array_join(F.transform("_i", lambda x: x["chunk"]), "").alias("text"))


def source_list(pages: DataFrame, job="job_id", url="url", title="title", text="markdown") -> DataFrame:
    return pages.filter(F.coalesce(text, F.lit("")) != "").select(
        job, url, F.coalesce(title, F.lit("")).alias("title"), F.length(text).alias("length"))


def resolve_template(jobs: DataFrame) -> DataFrame:
    """Own schema and system text of a job override those of its template.

    The registry is a fixed driver-side table, so it is a literal map, not a join.
    """
    def lookup(values: dict[str, str]):
        m = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
        return F.try_element_at(m, F.col("template"))

    schemas = {n: json.dumps(json_schema(t.schema)) for n, t in REGISTRY.items()}
    guides = {n: json.dumps(t.guide) for n, t in REGISTRY.items()}
    return jobs.withColumn("effective_schema", F.coalesce(F.when(F.col("schema") != "", F.col("schema")), lookup(schemas))).withColumn(
        "effective_system", F.coalesce(F.when(F.col("system_prompt") != "", F.col("system_prompt")), lookup({n: t.task for n, t in REGISTRY.items()}))
    ).withColumn("guide", lookup(guides)).withColumn(
        "merge", F.coalesce(lookup({n: t.merge for n, t in REGISTRY.items()}), F.lit("concat")))


def prompts(texts: DataFrame, template: Template | None, task: Column | None = None, output_format: str = "json",
            sources: Column | None = None, examples: list[dict] | None = None, text="text") -> DataFrame:
    """Prompt column: task, schema, guide, at most 3 examples, rules, at most 5 sources, text.

    ``sources`` is an array of (title, url) structs.
    """
    parts: list[Column] = [
        F.concat(F.lit("Extract the following information from web page content:\n\nTask: "), task, F.lit("\n"))
        if task is not None else F.lit("Extract all structured information that the following page content states.\n")
    ]
    need: list[str] = []
    if template is not None:
        need = template.required
        parts.append(F.lit("\nSCHEMA (valid JSON of exactly this shape):\n```json\n" + json.dumps(json_schema(template.schema), indent=2) + "\n```\n"))
        if template.guide:
            parts.append(F.lit("\nFIELD GUIDE:\n" + "".join(f"  - {k}: {v}\n" for k, v in template.guide.items())))
        for i, e in enumerate((examples or [])[:3]):
            parts.append(F.lit(f"\nExample {i + 1}:\n```json\n{json.dumps(e, indent=2)}\n```\n"))
    if output_format == "text":
        rules = ["Answer in plain text.", "Use no JSON.", "Add nothing that the page does not state."]
    elif output_format == "json" or template is not None:
        rules = ["Answer with one JSON object only.", "Use null for what the page does not state.", "Use [] for empty lists.",
                 "Add nothing that the page does not state."]
        if need:
            rules.append("Required fields: " + ", ".join(need))
    else:
        rules = ["Answer with a JSON object.", "Add nothing that the page does not state."]
    parts.append(F.lit("\nRULES:\n" + "".join(f"  {i}. {r}\n" for i, r in enumerate(rules, 1))))
    if sources is not None:
        lines = F.transform(F.slice(sources, 1, 5), lambda s: F.concat(F.lit("  - "), s["title"], F.lit(" | "), s["url"], F.lit("\n")))
        parts.append(F.concat(F.lit("\nSOURCE PAGES ("), F.size(sources).cast("string"), F.lit("):\n"), F.array_join(lines, "")))
    rule = "=" * 60
    parts.append(F.concat(F.lit(f"\n{rule}\n"), _c(text), F.lit(f"\n{rule}\n")))
    return texts.withColumn("prompt", F.concat(*parts))


# ---- answers -----------------------------------------------------------------------------

def strip_fences(answer) -> Column:
    a = X.strip_space(answer)
    a = F.regexp_replace(a, r"^```(?:json)?", "")
    return X.strip_space(F.regexp_replace(a, r"```$", ""))


def first_object(content: Column) -> Column:
    """Text from the first ``{`` to its matching ``}``, NULL when it never closes."""
    tail = F.regexp_extract(content, r"(?s)(\{.*)$", 1)
    # braces only, each with its depth change; strings do not hide braces
    marks = F.split(F.regexp_replace(tail, r"(?s)[^{}]", ""), "")
    depth = F.aggregate(
        marks, F.struct(F.lit(0).alias("d"), F.lit(0).alias("i"), F.lit(0).alias("end")),
        lambda a, m: F.struct(
            (a["d"] + F.when(m == "{", 1).when(m == "}", -1).otherwise(0)).alias("d"),
            (a["i"] + 1).alias("i"),
            F.when((a["end"] == 0) & (m == "}") & (a["d"] == 1), a["i"] + 1).otherwise(a["end"]).alias("end"),
        ))
    # the matching brace is the k-th mark: keep the text up to it
    pieces = F.split(tail, r"(?<=[{}])")
    return F.when((tail != "") & (depth["end"] > 0), F.array_join(F.slice(pieces, F.lit(1), depth["end"]), ""))


def repair(content) -> Column:
    """Remove trailing commas and comments; escape one raw line break between quotes."""
    c = F.regexp_replace(_c(content), r",\s*([}\]])", "$1")
    c = F.regexp_replace(c, r"//.*?\n", "\n")
    c = F.regexp_replace(c, r"(?s)/\*.*?\*/", "")
    return F.regexp_replace(c, r'(?<=")([^"]*)\n([^"]*)(?=")', r"$1\\n$2")


def _valid(c: Column) -> Column:
    """``data`` and ``value``, its variant, when the text is exactly one JSON value. The parser alone would ignore text
    behind the value; as the only item of a list nothing may follow."""
    def check(x):
        listed = F.try_parse_json(F.concat(F.lit("["), x, F.lit("]")))
        one = let(listed, lambda v: F.struct(F.try_variant_get(v, "$[0]", "variant").alias("value"), F.try_variant_get(v, "$[1]", "variant").isNull().alias("alone")))
        return let(one, lambda o: F.when(o["value"].isNotNull() & o["alone"], F.struct(x.alias("data"), o["value"].alias("value"))))

    return let(c, check)


def _read(text: Column) -> Column:
    return let(text, lambda x: F.when(x.isNotNull(), F.struct(x.alias("data"), F.try_parse_json(x).alias("value"))))


def parsed_answer(answer, object_expected: bool = True) -> Column:
    """``data``, the JSON text of an answer by the first way that works, else a raw-response marker, and ``value``, the same as
    a variant, so that later checks need not parse again.

    Every later way is only evaluated for rows where the earlier ones failed.
    """
    raw = _c(answer)

    def first_way(cleaned):
        any_object = F.regexp_extract(cleaned, r"(?s)(\{.*?\})", 1)
        any_array = F.regexp_extract(cleaned, r"(?s)(\[.*?\])", 1)
        arr = _valid(F.when(any_array != "", any_array))
        if object_expected:
            arr = _read(F.concat(F.lit('{"items":'), arr["data"], F.lit("}")))
        mended = let(repair(cleaned), lambda r: F.when(X.strip_space(r) != "", r))
        marker = F.to_json(F.struct(F.substring(raw, 1, 2000).alias("raw_response"), F.lit(True).alias("parse_error")))
        return F.coalesce(
            _valid(F.when(cleaned != "", cleaned)), _valid(first_object(cleaned)), _valid(F.when(any_object != "", any_object)),
            arr, _valid(mended), _read(marker))

    empty = F.lit('{"raw_response":"","parse_error":true,"error":"Empty response"}')
    blank = F.coalesce(X.strip_space(raw), F.lit("")) == ""
    return F.when(blank, _read(empty)).otherwise(let(strip_fences(raw), first_way))


def parse_answer(answer, object_expected: bool = True) -> Column:
    """JSON text of an answer, see ``parsed_answer``."""
    return parsed_answer(answer, object_expected)["data"]


# ---- validation --------------------------------------------------------------------------

# type texts of variants that each JSON type takes; an integer field also takes a boolean
_ACCEPTED = {"string": ["STRING"], "integer": ["BIGINT", "BOOLEAN"], "number": ["BIGINT", "DOUBLE", "BOOLEAN"], "boolean": ["BOOLEAN"],
             "array": ["ARRAY"], "object": ["OBJECT"]}
_KIND_NAMES = {"OBJECT": "dict", "ARRAY": "list", "STRING": "str", "BOOLEAN": "bool", "BIGINT": "int"}


def _none() -> Column:
    return F.array().cast("array<string>")


def _typed(v: Column) -> Column:
    """A value with its type text."""
    return F.struct(v.alias("v"), F.schema_of_variant(v).alias("type"))


def _members(v: Column, struct: T.StructType) -> Column:
    """Every member that a type names, with its type text, by one cast of the object; NULL for other values."""
    ddl = ", ".join(f"`{f.name}`: variant" for f in struct.fields)
    return let(F.try_variant_get(v, "$", f"struct<{ddl}>"), lambda m: F.when(
        m.isNotNull(), F.struct(*[_typed(m[f.name]).alias(f.name) for f in struct.fields])))


def _present(x: Column) -> Column:
    """A member that is there and not null."""
    return F.coalesce(x["type"] != "VOID", F.lit(False))


def _missing(m: Column, struct: T.StructType, path: Column) -> list[Column]:
    return [
        F.when(_present(m[f.name]), _none()).otherwise(F.array(F.concat(F.lit("Missing required field: '"), path, F.lit(f"{f.name}'"))))
        for f in struct.fields if not f.nullable
    ]


def _member_errors(m: Column, struct: T.StructType, path: Column) -> list[Column]:
    return _missing(m, struct, path) + [_field_errors(m[f.name], f.dataType, F.concat(path, F.lit(f.name))) for f in struct.fields]


def _field_errors(x: Column, dt: T.DataType, name: Column) -> Column:
    """Errors of one typed value against the type it should have: its own type, then its members.

    Members and items are only looked at when there are any, and not at all for a list whose type text already says all is
    well.
    """
    want = json_type(dt)
    if want is None:
        return _none()
    s = x["type"]
    t = F.substring_index(s, "<", 1)
    fits = s.isNull() | t.isin("VOID", *_ACCEPTED[want])
    if want == "number":
        fits = fits | t.startswith("DECIMAL")
    kind = F.lit("float")
    for k, n in _KIND_NAMES.items():
        kind = F.when(t == k, n).otherwise(kind)
    wrong = F.array(F.concat(F.lit("Field '"), name, F.lit("' has type "), kind, F.lit(f", expected {want}")))
    out = F
    if isinstance(dt, T.StructType) and dt.fields:
        out = out.when(t == "OBJECT", let(_members(x["v"], dt), lambda m: F.concat(*_member_errors(m, dt, F.concat(name, F.lit("."))))))
    if isinstance(dt, T.ArrayType):
        item = json_type(dt.elementType)
        clean = ["ARRAY<VOID>"] + [f"ARRAY<{a}>" for a in _ACCEPTED.get(item, []) if a not in ("ARRAY", "OBJECT")]
        items = F.transform(F.try_variant_get(x["v"], "$", "array<variant>"), lambda v, i: let(_typed(v), lambda y: _field_errors(
            y, dt.elementType, F.concat(name, F.lit("["), i.cast("string"), F.lit("]")))))
        out = out.when(s.isin(clean), _none()).when(t == "ARRAY", F.flatten(items))
    return out.when(fits, _none()).otherwise(wrong)


def _errors_of(m: Column, template: Template) -> Column:
    return F.when(m.isNull(), F.array(F.lit("Expected top-level JSON object"))).otherwise(
        F.concat(_none(), *_member_errors(m, template.schema, F.lit(""))))


def _confidence_of(m: Column, template: Template, errors: Column) -> Column:
    st = template.schema
    penalty = F.least(F.size(errors) * F.lit(0.12), F.lit(0.5))

    def filled(names):
        return reduce(lambda a, b: a + b, [_present(m[n]).cast("int") for n in names], F.lit(0))

    need = [f.name for f in st.fields if not f.nullable]
    free = [f.name for f in st.fields if f.nullable]
    req = filled(need) / F.lit(float(len(need))) if need else F.lit(1.0)
    points = req * 0.75 + filled(free) / F.lit(float(max(len(free), 1))) * 0.15
    return F.when(m.isNull(), 0.2).otherwise(F.least(F.greatest(points - penalty, F.lit(0.0)), F.lit(1.0)))


def validation_errors(data, template: Template) -> Column:
    """Error messages of a JSON answer against a template, required fields first."""
    return let(_members(F.try_parse_json(_c(data)), template.schema), lambda m: _errors_of(m, template))


def schema_confidence(data, template: Template, errors=None) -> Column:
    """0.75 x share of required + 0.15 x share of optional fields - 0.12 per error (at most
    0.5), within [0, 1]; 0.2 for anything that is not an object."""
    found = _c(errors) if errors is not None else validation_errors(data, template)
    return let(_members(F.try_parse_json(_c(data)), template.schema), lambda m: _confidence_of(m, template, found))


def typed_confidence(errors) -> Column:
    """Score of a user-typed record: 1 without errors, 0.15 less per error."""
    return F.greatest(F.lit(0.0), 1.0 - F.size(_c(errors)) * 0.15)


def score_answers(answers: DataFrame, template: Template, answer="answer", typed: bool = False) -> DataFrame:
    """Add parsed data, validation errors and confidence to raw answers. An answer is parsed once."""
    read = answers.withColumn("_a", parsed_answer(answer)).select("*", "_a.data", _members(F.col("_a.value"), template.schema).alias("_m")).drop("_a")
    out = read.withColumn("errors", _errors_of(F.col("_m"), template))
    score = typed_confidence("errors") if typed else _confidence_of(F.col("_m"), template, F.col("errors"))
    return out.withColumn("confidence", score).drop("_m")


def select_attempts(attempts: DataFrame, doc="doc_id", max_attempts: int = 3) -> DataFrame:
    """One result per document from ``(doc, attempt, data, confidence, errors, error)``.

    The first accepted attempt wins (0.75 without errors, or 0.85); else the most confident,
    earliest on ties. ``error`` is only set when no attempt gave an answer.
    """
    answered = F.col("data").isNotNull()
    good = answered & (((F.col("confidence") >= 0.75) & (F.size("errors") == 0)) | (F.col("confidence") >= 0.85))
    row = F.struct("attempt", "data", "confidence", "errors")
    best_key = F.struct("confidence", (-F.col("attempt")).alias("a"))
    g = attempts.groupBy(doc).agg(
        F.min_by(row, F.when(good, F.col("attempt"))).alias("_ok"),
        F.max_by(row, F.when(answered & (F.col("confidence") > 0), best_key)).alias("_best"),
        F.count_if(answered).alias("_n"),
        F.max_by("error", "attempt").alias("_err"),
    )
    ok, best = F.col("_ok"), F.col("_best")
    return g.select(
        doc,
        F.coalesce(ok["data"], best["data"], F.lit('{"error":"All extraction attempts failed"}')).alias("data"),
        F.coalesce(ok["confidence"], best["confidence"], F.lit(0.0)).alias("confidence"),
        F.coalesce(ok["attempt"], F.lit(max_attempts)).alias("attempts"),
        F.coalesce(ok["errors"], best["errors"], F.array().cast("array<string>")).alias("errors"),
        F.when(F.col("_n") == 0, F.concat(
            F.lit(f"All {max_attempts} extraction attempts failed. Last error: "), F.coalesce("_err", F.lit("None")))).alias("error"),
    )


def field_presence(results: DataFrame, data="data", keys: list[str] | None = None) -> DataFrame:
    """Rate of present values per field; empty strings and lists count as absent."""
    fields = F.from_json(data, "map<string,string>")
    rows = results.select(*(keys or []), F.explode(fields).alias("field", "value"))
    present = F.col("value").isNotNull() & ~F.col("value").isin("", "[]")
    return rows.groupBy(*(keys or []), "field").agg(
        F.count("*").alias("n"), F.count_if(present).alias("present"), F.avg(present.cast("double")).alias("rate"))


def success(confidence) -> Column:
    return _c(confidence) >= 0.3


def merge_pages(results: DataFrame, strategy: str, doc="doc_id", page="page", data="data") -> DataFrame:
    """Per-page answers of a document as one table.

    ``list`` keeps one row per page; ``concat`` one row per item of every list field, in page
    order; ``merge`` the first present value of each field.
    """
    if strategy == "list":
        return results.select(doc, page, data)
    rows = results.select(doc, page, F.explode(F.from_json(data, "map<string,string>")).alias("field", "value")).filter(
        F.col("value").isNotNull() & ~F.col("value").isin("", "[]"))
    if strategy == "merge":
        return rows.groupBy(doc, "field").agg(F.min_by("value", page).alias("value"))
    items = F.coalesce(F.try_variant_get(F.try_parse_json("value"), "$", "array<string>"), F.array("value"))
    return rows.select(doc, "field", page, F.posexplode(items).alias("pos", "item"))
