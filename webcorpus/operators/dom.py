"""Work that needs the document tree: nested noise, selectors, Markdown.

Spark partitions the pages and streams them to the workers in Arrow batches; only the asked
outputs are produced. The tree is a small helper over the standard library parser.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from .batches import pieces

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIP_TEXT = frozenset(["script", "style"])


class Node:
    """An element: tag name, attributes, children (elements and strings)."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs=(), parent=None):
        self.tag, self.attrs, self.children, self.parent = tag, dict(attrs), [], parent

    def walk(self):
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def strings(self):
        stack = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                yield c
            elif c.tag not in _SKIP_TEXT:
                stack.extend(reversed(c.children))

    def text(self, sep="", strip=False):
        parts = (s.strip() for s in self.strings()) if strip else self.strings()
        return sep.join(p for p in parts if p)

    def drop(self):
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def html(self):
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, tuple):
                out.append(n[0])
            elif isinstance(n, str):
                out.append(escape(n, quote=False))
            else:
                attrs = "".join(f' {k}="{escape(v or "")}"' for k, v in n.attrs.items())
                out.append(f"<{n.tag}{attrs}>")
                if n.tag not in _VOID:
                    stack.append((f"</{n.tag}>",))
                    stack.extend((c,) if isinstance(c, str) and n.tag in _SKIP_TEXT else c for c in reversed(n.children))
        return "".join(out)

    @property
    def classes(self):
        return (self.attrs.get("class") or "").split()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("")

    def handle_starttag(self, tag, attrs):
        node = Node(tag, attrs, self.here)
        self.here.children.append(node)
        if tag not in _VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.here.children.append(Node(tag, attrs, self.here))

    def handle_endtag(self, tag):
        n = self.here
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.here = n.parent

    def handle_data(self, data):
        self.here.children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def unlink(root: Node) -> None:
    """Takes a tree apart: parents and children hold each other, which only the garbage collector would find."""
    stack = [root]
    while stack:
        n = stack.pop()
        stack.extend(c for c in n.children if isinstance(c, Node))
        n.children, n.parent = [], None


# ---- selectors ---------------------------------------------------------------------------

_SIMPLE = re.compile(r"""([a-zA-Z][\w-]*|\*)|\.([\w-]+)|\#([\w-]+)|\[\s*([\w-]+)\s*(?:([~^$*]?=)\s*["']?([^"'\]]*)["']?\s*)?\]""")
_ATTR_TESTS = {
    "=": lambda have, want: have == want,
    "~=": lambda have, want: want in have.split(),
    "^=": lambda have, want: have.startswith(want),
    "$=": lambda have, want: have.endswith(want),
    "*=": lambda have, want: want in have,
}


@lru_cache(maxsize=1024)
def _tests(compound: str) -> tuple:
    return tuple(_SIMPLE.findall(compound))


def _matches_simple(node: Node, compound: str) -> bool:
    for tag, cls, ident, attr, op, value in _tests(compound):
        if tag and tag != "*" and node.tag != tag.lower():
            return False
        if cls and cls not in node.classes:
            return False
        if ident and node.attrs.get("id") != ident:
            return False
        if attr and (attr not in node.attrs or op and not _ATTR_TESTS[op](node.attrs[attr] or "", value)):
            return False
    return True


def _matches(node: Node, steps: list[str]) -> bool:
    """Right-to-left match of compounds joined by blanks or ``>``."""
    if not _matches_simple(node, steps[-1]):
        return False
    rest = steps[:-1]
    if not rest:
        return True
    if rest[-1] == ">":
        return node.parent is not None and bool(node.parent.tag) and _matches(node.parent, rest[:-1])
    up = node.parent
    while up is not None and up.tag:
        if _matches(up, rest):
            return True
        up = up.parent
    return False


def select(root: Node, selector: str) -> list[Node]:
    """Elements below ``root`` in document order for tags, .class, #id, [attr], blanks, ``>``, commas."""
    options = _options(selector)
    return [n for n in root.walk() if any(_matches(n, o) for o in options)]


@lru_cache(maxsize=1024)
def _options(selector: str) -> tuple[list[str], ...]:
    return tuple(re.sub(r"\s*>\s*", " > ", s.strip()).split() for s in selector.split(",") if s.strip())


# ---- content -----------------------------------------------------------------------------

_WORDS = frozenset(fixed.NOISE_CLASS_WORDS)
_SUFFIXES = tuple(fixed.NOISE_CLASS_SUFFIXES)


def is_noise(classes: list[str]) -> bool:
    words = (w for c in classes for w in re.split(r"[-_\s]+", c.lower()))
    return any(w in _WORDS or w.endswith(_SUFFIXES) for w in words)


def _first(root: Node, test) -> Node | None:
    return next((n for n in root.walk() if test(n)), None)


def content_element(root: Node, only_main: bool, largest: bool) -> Node:
    body = _first(root, lambda n: n.tag == "body") or root
    if not only_main:
        return body
    tests = (lambda n: n.tag == "main", lambda n: n.tag == "article", lambda n: n.attrs.get("role") == "main")
    main = next(filter(None, (_first(root, t) for t in tests)), None)
    if main is None and largest:
        # biggest block that is clearly smaller than the whole body
        bound = 0.95 * len(body.text())
        sized = [(len(n.text()), n) for n in root.walk() if n.tag in ("div", "section")]
        fitting = [x for x in sized if 0 < x[0] < bound]
        main = max(fitting, key=lambda x: x[0])[1] if fitting else None
    return main or body


def clean(root: Node, only_main=True, include=(), exclude=(), largest=False) -> Node:
    el = content_element(root, only_main, largest)
    if include:
        chosen = [parse(n.html()) for s in include for n in select(el, s)]
        el = Node("main")
        for c in chosen:
            for child in c.children:
                if isinstance(child, Node):
                    child.parent = el
                el.children.append(child)
    for s in exclude:
        for n in select(el, s):
            n.drop()
    for n in [n for n in el.walk() if n.tag in fixed.NOISE_TAGS or is_noise(n.classes)]:
        n.drop()
    return el


# ---- Markdown ----------------------------------------------------------------------------

_WRAP = {
    "p": "{}\n\n", "blockquote": "> {}\n\n", "pre": "```\n{}\n```\n\n", "li": "- {}\n", "figcaption": "*{}*\n",
    "strong": "**{}**", "b": "**{}**", "em": "*{}*", "i": "*{}*", "code": "`{}`",
    **{f"h{n}": "#" * n + " {}\n\n" for n in range(1, 7)},
}
_LINE_AFTER = frozenset(["ul", "ol", "table", "figure", "div", "section", "article"])


def _row(tr: Node) -> str:
    cells = [n for n in tr.walk() if n.tag in ("td", "th")]
    line = "| " + " | ".join(c.text().strip() for c in cells) + " |\n"
    head = any(c.tag == "th" for c in cells)
    return line + ("| " + " | ".join("---" for _ in cells) + " |\n" if head else "")


def _render(node: Node, inner: str) -> str:
    tag = node.tag
    if tag in _WRAP:
        return _WRAP[tag].format(inner.strip())
    if tag in _LINE_AFTER:
        return inner + "\n"
    if tag == "a":
        href = node.attrs.get("href") or ""
        return f"[{inner.strip()}]({href})" if href else inner
    if tag == "img":
        return f"![{node.attrs.get('alt') or ''}]({node.attrs.get('src') or ''})"
    if tag == "tr":
        return _row(node)
    return {"br": "\n", "hr": "---\n\n", "td": "", "th": "", "script": "", "style": ""}.get(tag, inner)


def markdown(root: Node) -> str:
    """ATX headings, ``-`` bullets, the whole page; iterative, so deep nesting is no problem."""
    done: dict[int, list[str]] = {}
    stack = [(root, False)]
    while stack:
        node, ready = stack.pop()
        if not ready:
            done[id(node)] = []
            stack.append((node, True))
            stack.extend((c, False) for c in reversed(node.children) if isinstance(c, Node))
            continue
        inner = "".join(c if isinstance(c, str) else done.pop(id(c))[0] for c in node.children)
        done[id(node)] = [_render(node, inner) if node is not root else inner]
    text = done[id(root)][0]
    return re.sub(r"\n{3,}", "\n\n", text).strip()


# ---- the Spark job -----------------------------------------------------------------------

_RESULT_CHARS = 1 << 21
_OUTPUTS = {
    "content_html": ("string", lambda el: el.html()),
    "text": ("string", lambda el: re.sub(r"\s+", " ", el.text()).strip()),
    "markdown": ("string", markdown),
    "links": ("array<string>", lambda el: [n.attrs["href"] for n in el.walk() if n.tag == "a" and n.attrs.get("href") is not None]),
}


def extract(pages: DataFrame, page_id: str, html: str, outputs: list[str], only_main: bool = True,
            include: list[str] | None = None, exclude: list[str] | None = None, largest: bool = False) -> DataFrame:
    """``page_id`` and the asked outputs of the cleaned content element of every page.

    ``include`` keeps the elements matching the selectors, concatenated; ``exclude`` removes
    matches; ``largest`` falls back to the biggest block of pages without a main element.
    """
    inc, exc = tuple(include or ()), tuple(exclude or ())
    id_type = pages.schema[page_id].dataType.simpleString()
    schema = ", ".join([f"`{page_id}` {id_type}"] + [f"{o} {_OUTPUTS[o][0]}" for o in outputs])

    kinds = [pa.list_(pa.string()) if _OUTPUTS[o][0] == "array<string>" else pa.string() for o in outputs]

    def job(batches):
        for names, bodies in pieces(batches):
            cols: dict[str, list] = {o: [] for o in outputs}
            begun = size = 0
            for i, h in enumerate(bodies.to_pylist(), 1):
                root = parse(h)
                el = clean(root, only_main, inc, exc, largest)
                for o in outputs:
                    cols[o].append(_OUTPUTS[o][1](el))
                    size += len(cols[o][-1])
                unlink(root)
                unlink(el)
                # cells that nobody closes lie in each other and come out many times: results leave as they grow
                if i == len(bodies) or size > _RESULT_CHARS:
                    yield pa.RecordBatch.from_arrays([names.slice(begun, i - begun), *(pa.array(cols[o], k) for o, k in zip(outputs, kinds))], names=[page_id, *outputs])
                    cols, begun, size = {o: [] for o in outputs}, i, 0

    return pages.select(page_id, html).mapInArrow(job, schema)


def scrape(pages: DataFrame, page_id: str = "page_id", html: str = "html", formats: list[str] | None = None, **kw) -> DataFrame:
    """Markdown, content HTML and main links with base64 images stripped from the Markdown."""
    outs = formats or ["markdown", "content_html", "links"]
    out = extract(pages, page_id, html, outs, **kw)
    if "markdown" in outs:
        out = out.withColumn("markdown", F.regexp_replace("markdown", fixed.BASE64_IMAGE, ""))
    return out
