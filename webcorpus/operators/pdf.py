"""Text of paged documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def join_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """Page texts of a document joined by blank lines; empty pages leave a note.

    A document's pages are one value in the end, so the group is the size of a document.
    """
    note = F.concat(F.lit("[Page "), F.col(page).cast("string"), F.lit(": no extractable text]"))
    body = F.when(F.coalesce(text, F.lit("")) == "", note).otherwise(F.col(text))
    items = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), body.alias("t"))))
    return pages.groupBy(doc).agg(items.alias("_i")).select(
        doc, F.array_join(F.transform("_i", lambda x: x["t"]), "\n\n").alias("text"))
