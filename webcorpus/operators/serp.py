"""Search-result pages to ranked result rows."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import urls as U
from . import dom
from .batches import pieces
from .segments import top_k


@dataclass(frozen=True)
class Engine:
    """Where a result block, its link, title and snippet are; later selectors are fallbacks."""

    base_url: str
    block: str
    link: tuple[str, ...]
    title: tuple[str, ...]
    snippet: tuple[str, ...]
    wrapper: str | None = None


# ---- fixed values: result page layouts -------------------------------------------------------
ENGINES: dict[str, Engine] = {
    "bing": Engine("https://www.bing.com/search", "li.b_algo", ("h2 a",), (), (".b_caption p", "p"), "bing"),
    "brave": Engine("https://search.brave.com/search", "div.snippet[data-type=web]", ("a[href].l1", "a[href]"),
                    (".search-snippet-title", ".title"), (".generic-snippet .content", ".generic-snippet")),
    "duckduckgo": Engine("https://html.duckduckgo.com/html/", ".result.results_links.web-result", ("a.result__a",), (),
                         ("a.result__snippet", ".result__snippet"), "ddg"),
}
# ---- end of fixed values -----------------------------------------------------------------------


def register_engine(name: str, engine: Engine) -> None:
    ENGINES[name] = engine


def _pick(block: dom.Node, selectors: tuple[str, ...]) -> dom.Node | None:
    return next((hit[0] for hit in (dom.select(block, s) for s in selectors) if hit), None)


def results(pages: DataFrame, engine: str, page_id: str = "page_id", html: str = "html", limit: int = 10) -> DataFrame:
    """(page_id, rank, title, link, snippet): first ``limit`` distinct safe links per page."""
    e = ENGINES[engine]
    id_type = pages.schema[page_id].dataType.simpleString()

    def blocks(batches):
        for names, bodies in pieces(batches):
            rows = []
            for pid, h in zip(names.to_pylist(), bodies.to_pylist()):
                root = dom.parse(h)
                for pos, b in enumerate(dom.select(root, e.block)):
                    a = _pick(b, e.link)
                    if a is None or not a.attrs.get("href"):
                        continue
                    t, s = (_pick(b, e.title) or a), _pick(b, e.snippet)
                    rows.append((pid, pos, a.attrs["href"], t.text(" ", strip=True), s.text(" ", strip=True) if s else ""))
                dom.unlink(root)
            if rows:
                kinds = [names.type, pa.int32(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[page_id, "pos", "href", "title", "snippet"])

    raw = pages.select(page_id, html).mapInArrow(
        blocks, f"`{page_id}` {id_type}, pos int, href string, title string, snippet string")
    link = U.result_url("href", e.base_url, bing=e.wrapper == "bing", ddg=e.wrapper == "ddg")
    safe = raw.withColumn("link", link).filter("link <> ''")
    once = top_k(safe, [page_id, "link"], [F.col("pos")], 1).filter("title <> ''")
    return top_k(once, [page_id], [F.col("pos")], limit, name="rank").select(page_id, "rank", "title", "link", "snippet")
