"""Extraction templates: record types with required (NOT NULL) fields."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..functions import fixed


_SIMPLE = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}


def spark_type(shape) -> T.DataType:
    """Spark type of a shape: a type name, ``[item]``, ``{}`` for free keys, or a record whose
    required fields end in ``!``."""
    if isinstance(shape, str):
        return _SIMPLE[shape]
    if isinstance(shape, list):
        return T.ArrayType(spark_type(shape[0]))
    if not shape:
        return T.MapType(T.StringType(), T.StringType())
    return T.StructType([T.StructField(k.rstrip("!"), spark_type(v), not k.endswith("!")) for k, v in shape.items()])


@dataclass(frozen=True)
class Template:
    """A named record type for extraction: a shape, a Spark struct or DDL text.

    Required fields are the non-nullable ones, or those listed in ``need``.
    """

    name: str
    record: dict | T.StructType | str
    need: list[str] | None = None
    task: str = ""
    guide: dict[str, str] = field(default_factory=dict)
    max_page_chars: int = fixed.PAGE_CHARS
    merge: str = "concat"

    @property
    def schema(self) -> T.StructType:
        r = self.record
        st = T.StructType.fromDDL(r) if isinstance(r, str) else r if isinstance(r, T.StructType) else spark_type(r)
        if self.need is None:
            return st
        return T.StructType([T.StructField(f.name, f.dataType, f.name not in self.need) for f in st.fields])

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema.fields if not f.nullable]


# ---- fixed values: field names, types, required fields and merge rules of the templates ----
_BUILT_IN = [
    Template("product", {
        "product_name": "string", "brand": "string", "price": "string", "original_price": "string",
        "currency": "string", "availability": "string", "rating": "number", "review_count": "integer",
        "description": "string", "features": ["string"], "specifications": {}, "images": ["string"],
        "category": "string", "sku": "string", "url": "string",
    }, ["product_name", "price"],
        "Collect the facts about the product sold on this page; keep currency symbols in prices.",
        {"price": "number next to a currency symbol", "rating": "mean score as a bare number",
         "availability": "stock or order button wording", "features": "bullet list of the product"}),
    Template("article", {
        "title": "string", "author": "string", "published_date": "string", "summary": "string", "content": "string",
        "tags": ["string"], "category": "string", "reading_time_minutes": "integer", "url": "string",
        "word_count": "integer",
    }, ["title", "content"],
        "Collect the text and the publication facts of this article.",
        {"published_date": "date line near the headline", "author": "byline", "content": "body text without comments"}),
    Template("job_posting", {
        "job_title": "string", "company": "string", "location": "string", "remote_status": "string",
        "salary": "string", "employment_type": "string", "description": "string", "requirements": ["string"],
        "nice_to_have": ["string"], "benefits": ["string"], "application_url": "string", "posted_date": "string",
        "url": "string",
    }, ["job_title", "company"],
        "Collect the facts of this vacancy; keep must-have and optional skills apart."),
    Template("real_estate", {
        "property_type": "string", "price": "string", "currency": "string", "address": "string", "city": "string",
        "state": "string", "zip_code": "string", "country": "string", "bedrooms": "integer", "bathrooms": "number",
        "square_feet": "integer", "lot_size": "string", "year_built": "integer", "description": "string",
        "features": ["string"], "images": ["string"], "listing_agent": "string", "agent_phone": "string",
        "url": "string", "status": "string",
    }, ["price", "address"],
        "Collect the facts of this property listing."),
    Template("person", {
        "name": "string", "title": "string", "organization": "string", "email": "string", "phone": "string",
        "linkedin": "string", "twitter": "string", "bio": "string", "expertise": ["string"], "education": ["string"],
        "image_url": "string",
    }, ["name"],
        "Collect the profile facts of the person on this page."),
    Template("event", {
        "event_name": "string", "organizer": "string", "start_date": "string", "end_date": "string",
        "location": "string", "venue": "string", "description": "string", "ticket_price": "string",
        "registration_url": "string", "speakers": ["string"], "topics": ["string"], "format": "string",
        "url": "string",
    }, ["event_name"],
        "Collect the facts of this event; dates as ISO 8601."),
    Template("review", {
        "overall_rating": "number", "total_reviews": "integer",
        "reviews": [{"author": "string", "rating": "number", "date": "string", "title": "string", "body": "string", "verified": "boolean"}],
        "pros": ["string"], "cons": ["string"], "url": "string",
    }, ["overall_rating"],
        "Collect every review on this page with its score.", merge="list"),
    Template("faq", {
        "faq_items": [{"question!": "string", "answer!": "string", "category": "string"}], "url": "string",
    }, ["faq_items"],
        "Collect every question with its answer.", merge="merge"),
    Template("recipe", {
        "recipe_name": "string", "author": "string", "description": "string", "prep_time": "string",
        "cook_time": "string", "total_time": "string", "servings": "string", "difficulty": "string",
        "ingredients": ["string"], "instructions": ["string"], "nutrition": {}, "tags": ["string"],
        "cuisine": "string", "diet": ["string"], "image_url": "string", "url": "string",
    }, ["recipe_name", "ingredients", "instructions"],
        "Collect the recipe with amounts and units."),
    Template("research_paper", {
        "title": "string", "authors": ["string"], "abstract": "string", "publication_date": "string",
        "journal": "string", "doi": "string", "arxiv_id": "string", "keywords": ["string"],
        "citations_count": "integer", "pdf_url": "string", "url": "string",
    }, ["title"],
        "Collect the bibliographic facts of this paper."),
]
# ---- end of fixed values -------------------------------------------------------------------

REGISTRY: dict[str, Template] = {t.name: t for t in _BUILT_IN}


def register_template(name: str, schema: T.StructType | str, required: list[str] | None = None, **kw) -> Template:
    """Add a user-defined record type; ``required`` overrides the nullability of top fields."""
    REGISTRY[name] = t = Template(name, schema, required, **kw)
    return t


def get_template(name: str) -> Template:
    if name not in REGISTRY:
        raise KeyError(f"unknown template {name!r}; known: {', '.join(REGISTRY)}")
    return REGISTRY[name]


def json_type(dt: T.DataType) -> str | None:
    """JSON name of a type; VARIANT stands for any value."""
    if isinstance(dt, T.VariantType):
        return None
    if isinstance(dt, T.StringType):
        return "string"
    if isinstance(dt, (T.LongType, T.IntegerType, T.ShortType)):
        return "integer"
    if isinstance(dt, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "number"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, T.ArrayType):
        return "array"
    return "object"


def json_schema(dt: T.DataType) -> dict:
    """JSON schema of a Spark type, for the prompt."""
    out: dict = {"type": json_type(dt)} if json_type(dt) else {}
    if isinstance(dt, T.ArrayType) and json_type(dt.elementType):
        out["items"] = json_schema(dt.elementType)
    if isinstance(dt, T.StructType):
        out["properties"] = {f.name: json_schema(f.dataType) for f in dt.fields}
        need = [f.name for f in dt.fields if not f.nullable]
        if need:
            out["required"] = need
    return out


def json_schema_text(template: Template) -> str:
    return json.dumps(json_schema(template.schema), indent=2)
