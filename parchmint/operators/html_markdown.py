"""HTML to a tree, an allow-list over it, and its Markdown."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.functions.batches import bounded_batches
from parchmint.operators.page_layout import SPACES

# Fixed lists: the elements and link schemes that stay.
ALLOWED = frozenset("h1 h2 h3 h4 h5 h6 p br hr strong b em i u del s a ul ol li table thead tbody tr th td blockquote pre code".split())
SAFE_SCHEMES = frozenset(("https", "http", "mailto"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_FORMATTING = frozenset("a b code del em i s strong u".split())
_SCOPE = frozenset(("td", "th", "table", "html", "body", "caption"))
#: An end that the parser supplies: opening the key closes an open one of the values, up to the scope's bound.
_IMPLIED = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
_HEAD = frozenset("base link meta script style template title noscript".split())
#: Script, style and comments, in which nothing is a reference; and whatever may be one elsewhere.
_AMPERSAND = re.compile(r"(<(script|style)\b[^>]*>.*?(?:</\2\s*>|\Z)|<!--.*?(?:-->|\Z))|&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?", re.DOTALL | re.IGNORECASE)


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def text(self) -> str:
        """All text below, in order."""
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo.extend(reversed(x.children))
        return "".join(out)

    def all(self, *tags: str) -> list[Node]:
        """Elements below with one of the tags, in order."""
        out, todo = [], list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, Node):
                if x.tag in tags:
                    out.append(x)
                todo.extend(reversed(x.children))
        return out


class _Builder(HTMLParser):
    """A tree with the ends that browsers supply; formatting left open by a closed block goes on in the next."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.body = Node("body")
        self.stack = [self.body]
        self.skip = 0
        self.pending: list[Node] = []

    def _close_to(self, i: int) -> None:
        self.pending += [n for n in self.stack[i + 1 :] if n.tag in _FORMATTING]
        del self.stack[i:]

    def _resume(self) -> None:
        for old in self.pending:
            node = Node(old.tag, old.attrs)
            self.stack[-1].children.append(node)
            self.stack.append(node)
        self.pending = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body", "head"):
            return
        if tag in ("title",) and len(self.stack) == 1:
            self.skip += 1
            return
        if tag in _HEAD and tag in _VOID:
            return
        if tag in _ENDS_P:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag == "p":
                    self._close_to(i)
                    break
                if self.stack[i].tag in _SCOPE:
                    break
        closes, bound = _IMPLIED.get(tag, (frozenset(), frozenset()))
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in bound:
                break
            if self.stack[i].tag in closes:
                self._close_to(i)
                break
        if tag not in _ENDS_P and tag not in ("tr", "td", "th", "tbody", "thead", "li"):
            self._resume()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(node)
        if tag not in _VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "title" and self.skip:
            self.skip -= 1
            return
        if tag in _FORMATTING:
            for i, node in enumerate(self.pending):
                if node.tag == tag:
                    del self.pending[i]
                    return
        if tag == "br":
            self.handle_starttag("br", [])
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._close_to(i)
                return
            if self.stack[i].tag in ("td", "th", "table") and tag not in ("td", "th", "tr", "tbody", "thead", "table"):
                return

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.pending and data.strip(SPACES):
            self._resume()
        self.stack[-1].children.append(data)


def ended_references(html: str) -> str:
    """The page with every ampersand spelt out that begins no reference ended by a semicolon."""
    return _AMPERSAND.sub(lambda m: m[0] if m[1] or (m[3] and (m[3][0] == "#" or m[3] in html5)) else "&amp;" + m[0][1:], html)


def parse(html: str, lenient: bool = True) -> Node:
    """The tree of a page. Browsers, and ``lenient``, also take old names without their semicolon (``&amp``) for references."""
    builder = _Builder()
    builder.feed(html if lenient else ended_references(html))
    builder.close()
    return builder.body


def sanitize(node: Node) -> Node:
    """The tree with disallowed elements replaced by their text, once, and attributes removed but for safe absolute links."""
    out = Node(node.tag)
    todo = [(node, out)]
    while todo:
        old, new = todo.pop()
        for child in old.children:
            if isinstance(child, str):
                new.children.append(child)
            elif child.tag not in ALLOWED:
                new.children.append(child.text())
            else:
                href = child.attrs.get("href") if child.tag == "a" else None
                copy = Node(child.tag, {"href": href} if href is not None and safe_link(href) else {})
                new.children.append(copy)
                todo.append((child, copy))
    return out


def safe_link(href: str) -> bool:
    try:
        parts = urlsplit(href.strip())
    except ValueError:
        return False
    return parts.scheme.lower() in SAFE_SCHEMES and (parts.scheme.lower() == "mailto" or bool(parts.netloc))


_WRAPPED = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~"}


def _table(node: Node) -> str:
    rows = [[c.text().strip(SPACES).replace("|", "\\|") for c in r.all("th", "td")] for r in node.all("tr")]
    if not rows:
        return "\n"
    shown = [rows[0], ["---"] * len(rows[0]), *(r for r in rows[1:] if any(r))]
    return "\n" + "".join("| " + " | ".join(r) + " |\n" for r in shown) + "\n"


def _leaf(node: Node) -> str | None:
    """Markdown of an element that is not merely a container; None for those that are."""
    tag = node.tag
    if tag in ("br", "hr"):
        return "\n" if tag == "br" else "\n---\n"
    if tag in ("ul", "ol"):
        texts = [t for li in node.children if isinstance(li, Node) and li.tag == "li" and (t := li.text().strip(SPACES))]
        return "\n" + "".join((f"{k}. " if tag == "ol" else "- ") + t + "\n" for k, t in enumerate(texts, 1)) + "\n"
    if tag == "table":
        return _table(node)
    heading = re.fullmatch("h([1-6])", tag)
    if not (heading or tag in _WRAPPED or tag in ("p", "code", "pre", "blockquote", "a")):
        return None
    raw = node.text()
    text = raw.strip(SPACES)
    if tag == "code":
        return f"`{raw}`" if raw else ""
    if tag == "pre":
        return f"\n```\n{raw}\n```\n" if raw else ""
    if not text:
        return ""
    if heading:
        return f"\n{'#' * int(heading[1])} {text}\n"
    if tag == "p":
        return f"\n{text}\n"
    if tag == "blockquote":
        return "\n" + "\n".join("> " + line for line in text.split("\n")) + "\n"
    if tag == "a":
        return f"[{text}]({node.attrs['href']})" if node.attrs.get("href") else text
    return _WRAPPED[tag] + text + _WRAPPED[tag]


def to_markdown(root: Node) -> str:
    out, todo = [], list(reversed(root.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x.strip(SPACES))
            continue
        done = _leaf(x)
        if done is None:
            todo.extend(reversed(x.children))
        else:
            out.append(done)
    return re.sub("\n{3,}", "\n\n", "".join(out)).strip(SPACES)


def html_markdown(html: str, clean: bool = True, lenient: bool = True) -> str:
    tree = parse(html, lenient)
    return to_markdown(sanitize(tree) if clean else tree)


def html_to_markdown(df: DataFrame, html_col: str = "html", clean: bool = True, lenient: bool = True) -> DataFrame:
    """``df`` without its html, with markdown and error; ``lenient`` as in ``parse``."""
    rest = [c for c in df.columns if c not in (html_col, "markdown", "error")]

    def convert(batches):
        for batch in batches:
            out: list[tuple[str | None, str | None]] = []
            for html in batch.column(html_col).to_pylist():
                try:
                    out.append((html_markdown(html or "", clean, lenient), None))
                except Exception as e:  # one document must not end the job
                    out.append((None, f"{type(e).__name__}: {e}"[:500]))
            columns = [batch.column(c) for c in rest] + [pa.array([o[k] for o in out], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, "markdown", "error"])

    from pyspark.sql.types import StringType, StructField, StructType

    bounded_batches(df.sparkSession)
    kept = df.select(*rest, html_col)
    schema = StructType([*(kept.schema[c] for c in rest), StructField("markdown", StringType()), StructField("error", StringType())])
    return kept.mapInArrow(convert, schema)


def links(html: Column) -> Column:
    """The href values of a page by pattern, without a tree."""
    return F.regexp_extract_all(html, F.lit(r"""<a\s[^>]*?href="([^"]*)\""""), F.lit(1))
