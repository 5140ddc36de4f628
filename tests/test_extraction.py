import json

import pytest
from pyspark.sql import functions as F, types as T

from webcorpus.operators import extraction as Ex
from webcorpus.operators.templates import REGISTRY, Template, get_template, json_schema, register_template

REQUIRED = {
    "product": ["product_name", "price"], "article": ["title", "content"], "job_posting": ["job_title", "company"], "real_estate": ["price", "address"], "person": ["name"],
    "event": ["event_name"], "review": ["overall_rating"], "faq": ["faq_items"], "recipe": ["recipe_name", "ingredients", "instructions"], "research_paper": ["title"],
}
FIELDS = {"product": 15, "article": 10, "job_posting": 13, "real_estate": 20, "person": 11, "event": 13, "review": 6, "faq": 2, "recipe": 16, "research_paper": 11}


@pytest.mark.parametrize("name", REQUIRED)
def test_templates(spark, name):
    t = get_template(name)
    assert t.required == REQUIRED[name] and len(t.schema.fields) == FIELDS[name]
    assert json_schema(t.schema)["required"] == REQUIRED[name]


def test_template_details(spark):
    faq = json_schema(get_template("faq").schema)["properties"]["faq_items"]
    assert faq["items"]["required"] == ["question", "answer"]
    assert REGISTRY["review"].merge == "list" and REGISTRY["faq"].merge == "merge" and REGISTRY["product"].merge == "concat"
    with pytest.raises(KeyError):
        get_template("nope")
    register_template("mine", "a STRING, b INT", required=["b"])
    assert get_template("mine").required == ["b"]
    del REGISTRY["mine"]


@pytest.mark.parametrize("raw, want", [
    ('{"title": "Hello", "content": "World"}', {"title": "Hello", "content": "World"}), ('```json\n{"title": "Hello"}\n```', {"title": "Hello"}), ('```\n{"title": "Hello"}\n```', {"title": "Hello"}),
    ('Here is the result:\n{"title": "Hello"}\nThat is all.', {"title": "Hello"}), ("This is not JSON at all", {"raw_response": "This is not JSON at all", "parse_error": True}),
    ('{"data": {"nested": true}, "count": 5}', {"data": {"nested": True}, "count": 5}), ("", {"raw_response": "", "parse_error": True, "error": "Empty response"}),
    ("so: [1, 2] ok", {"items": [1, 2]}), ('{"a": 1, }', {"a": 1}), ('{"a": 1 /* one */}', {"a": 1}), ('{"a": "x\ny"}', {"a": "x\ny"}), ('{"a": {"b": 1}} {"c": 2}', {"a": {"b": 1}}),
])
def test_parse_answers(col, raw, want):
    assert json.loads(col(Ex.parse_answer, [raw])[0]) == want


def check(spark, data, ddl):
    t = Template("t", ddl)
    r = spark.createDataFrame([(json.dumps(data),)], "d string").withColumn("e", Ex.validation_errors("d", t)).withColumn("c", Ex.schema_confidence("d", t, "e")).first()
    assert 0.0 <= r.c <= 1.0
    return round(r.c, 6), r.e


@pytest.mark.parametrize("data, ddl, low, high, errors", [
    ({"title": "Test", "content": "Hello"}, "title STRING NOT NULL, content STRING NOT NULL", 0.7, 1, []),
    ({"title": "Test"}, "title STRING NOT NULL, content STRING NOT NULL", 0, 0.7, ["Missing required field: 'content'"]),
    ({"title": "Test"}, "title STRING", 0.7, 1, []),
    ("not a dict", "title STRING", 0.2, 0.2, ["Expected top-level JSON object"]),
    ([1, 2, 3], "x STRING", 0.2, 0.2, ["Expected top-level JSON object"]),
    ({}, "title STRING NOT NULL", 0, 0.3, ["Missing required field: 'title'"]),
    ({"count": "not_a_number", "title": "valid"}, "count BIGINT, title STRING", 0, 1, ["Field 'count' has type str, expected integer"]),
    ({"count": 42, "active": True}, "count BIGINT, active BOOLEAN", 0.5, 1, []),
    ({"count": True, "price": True}, "count BIGINT, price DOUBLE", 0.5, 1, []),
    ({"price": 10}, "price DOUBLE", 0.5, 1, []), ({"price": 10.5}, "price DOUBLE", 0.5, 1, []), ({"price": 1e30}, "price DOUBLE", 0.5, 1, []),
    ({"tags": ["a", 1]}, "tags ARRAY<VARIANT>", 0.5, 1, []), ({"tags": "not array"}, "tags ARRAY<STRING>", 0, 1, ["Field 'tags' has type str, expected array"]),
    ({"name": "T", "address": {"city": "Berlin", "zip": "10115"}}, "name STRING NOT NULL, address STRUCT<city: STRING NOT NULL, zip: STRING>", 0.5, 1, []),
    ({"name": "T", "address": {}}, "name STRING NOT NULL, address STRUCT<city: STRING NOT NULL>", 0, 1, ["Missing required field: 'address.city'"]),
    ({"meta": {"count": "x"}}, "meta STRUCT<count: BIGINT>", 0, 1, ["Field 'meta.count' has type str, expected integer"]),
    ({"a": 1, "b": "x", "c": "yes"}, "a STRING NOT NULL, b BIGINT NOT NULL, c BOOLEAN NOT NULL", 0, 0.5,
     ["Field 'a' has type int, expected string", "Field 'b' has type str, expected integer", "Field 'c' has type str, expected boolean"]),
    ({"l": [{"q": 1}, 2]}, "l ARRAY<STRUCT<q: STRING NOT NULL, r: STRING NOT NULL>>", 0, 1,
     ["Field 'l[0].q' has type int, expected string", "Missing required field: 'l[0].r'", "Field 'l[1]' has type int, expected object"]),
    ({"a": None}, "a STRING NOT NULL", 0, 0.1, ["Missing required field: 'a'"]),
])
def test_validation(spark, data, ddl, low, high, errors):
    conf, got = check(spark, data, ddl)
    assert low <= conf <= high and sorted(got) == sorted(errors)


def test_exact_scores(spark):
    assert check(spark, {"a": "x"}, "a STRING NOT NULL, b STRING, c STRING")[0] == 0.75
    assert check(spark, {"a": "x", "b": "y", "c": "z"}, "a STRING NOT NULL, b STRING, c STRING")[0] == 0.9
    assert check(spark, {"a": 1, "b": "y"}, "a STRING NOT NULL, b STRING, c STRING")[0] == round(0.75 + 0.075 - 0.12, 6)


def test_attempts(spark):
    rows = [
        ("first good", 1, "a", 0.8, [], None), ("first good", 2, "b", 0.9, [], None), ("minor errors", 1, "a", 0.8, ["e"], None), ("minor errors", 2, "b", 0.86, ["e"], None),
        ("best of bad", 1, "a", 0.4, ["e"], None), ("best of bad", 2, "b", 0.5, ["f"], None), ("best of bad", 3, "c", 0.5, ["g"], None), ("none", 1, None, None, None, "x"), ("none", 3, None, None, None, "late"),
    ]
    df = spark.createDataFrame(rows, "doc_id string, attempt int, data string, confidence double, errors array<string>, error string")
    got = {r.doc_id: (r.data, r.confidence, r.attempts, r.errors, r.error) for r in Ex.select_attempts(df).collect()}
    assert got["first good"] == ("a", 0.8, 1, [], None) and got["minor errors"] == ("b", 0.86, 2, ["e"], None) and got["best of bad"] == ("b", 0.5, 3, ["f"], None)
    assert got["none"] == ('{"error":"All extraction attempts failed"}', 0.0, 3, [], "All 3 extraction attempts failed. Last error: late")


def plain_budget(pages, per_page, total):
    parts, used = [], 0
    for pos, url, title, text in pages:
        marker = f"\n---\n\U0001F4C4 Page {pos}: {title}\n\U0001F517 URL: {url}\n---\n"
        body = text[:per_page]
        if used + len(marker) + len(body) > total:
            room = total - used - len(marker) - 100
            if room <= 500:
                break
            body = body[:room]
        parts.append(marker + body)
        used += len(parts[-1])
    return "".join(parts)


@pytest.mark.parametrize("sizes", [[10, 20], [900, 900, 900, 900], [3000, 5, 5], [1200, 1200, 300, 10, 10], [2990, 10, 1, 1], [2200, 900, 3, 2, 1, 1, 900]])
def test_page_budget_against_plain_loop(spark, sizes):
    pages = [(i + 1, "u", "t", "x" * n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame([(1, *p) for p in pages], "job_id int, position int, url string, title string, markdown string")
    out = Ex.concatenate(Ex.page_budget(df, per_page=2500, total=3000)).first()
    assert (out.text if out else "") == plain_budget(pages, 2500, 3000)


def test_prompt(spark):
    df = spark.createDataFrame([("body", [("T", "http://u")])], "text string, s array<struct<title:string,url:string>>")
    p = Ex.prompts(df, get_template("product"), F.lit("find it"), sources=F.col("s"), examples=[{"a": i} for i in range(5)]).first().prompt
    assert "Task: find it" in p and '"product_name"' in p and "Required fields: product_name, price" in p and "Example 3" in p and "Example 4" not in p and "T | http://u" in p and "body" in p
    assert "plain text" in Ex.prompts(df, None, output_format="text").first().prompt


def test_merge_strategies(spark):
    rows = [(1, 0, '{"a": null, "l": ["x"], "b": ""}'), (1, 1, '{"a": "one", "l": ["y", "z"], "b": "two"}'), (1, 2, '{"a": "late"}')]
    df = spark.createDataFrame(rows, "doc_id int, page int, data string")
    assert {(r.field, r.value) for r in Ex.merge_pages(df, "merge").collect()} >= {("a", "one"), ("b", "two"), ("l", '["x"]')}
    items = Ex.merge_pages(df, "concat").filter("field = 'l'").orderBy("page", "pos").collect()
    assert [r.item for r in items] == ["x", "y", "z"] and Ex.merge_pages(df, "list").count() == 3
