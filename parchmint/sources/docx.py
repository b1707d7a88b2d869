"""Word-processing documents to HTML and messages, with the standard library.

Paragraphs, runs (bold, italic, strike), hyperlinks, tables and line breaks are read;
insertions stay, deletions and comments go. Heading and list styles are mapped only with
``styles``; otherwise a named style is reported as a warning, once each.
"""

from __future__ import annotations

import re
from html import escape
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_HEADING = re.compile(r"(?i)heading\s*([1-6])$")


class _Reader:
    def __init__(self, relations: str | None, styles: bool):
        self.links = {}
        if relations:
            for r in ElementTree.fromstring(relations):
                self.links[r.get("Id")] = r.get("Target", "")
        self.styles = styles
        self.messages: dict[str, None] = {}

    def run(self, run) -> str:
        out = []
        for x in run:
            if x.tag == _W + "t":
                out.append(escape(x.text or "", quote=False))
            elif x.tag == _W + "tab":
                out.append("\t")
            elif x.tag in (_W + "br", _W + "cr"):
                out.append("<br />")
            elif x.tag in (_W + "drawing", _W + "pict", _W + "object"):
                self.messages.setdefault("An image was left out")
        text = "".join(out)
        props = run.find(_W + "rPr")
        for name, tag in (("strike", "s"), ("i", "em"), ("b", "strong")):
            mark = props.find(_W + name) if props is not None else None
            if text and mark is not None and mark.get(_W + "val") not in ("0", "false", "off"):
                text = f"<{tag}>{text}</{tag}>"
        return text

    def inline(self, parent) -> str:
        out = []
        for x in parent:
            if x.tag == _W + "r":
                out.append(self.run(x))
            elif x.tag == _W + "hyperlink":
                href = self.links.get(x.get(_R + "id"), "")
                body = self.inline(x)
                out.append(f'<a href="{escape(href)}">{body}</a>' if href else body)
            elif x.tag in (_W + "ins", _W + "smartTag", _W + "sdt", _W + "sdtContent", _W + "fldSimple", _W + "moveTo"):
                out.append(self.inline(x))
        return "".join(out)

    def paragraph(self, p) -> str:
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = style.get(_W + "val", "") if style is not None else ""
        listed = p.find(f"{_W}pPr/{_W}numPr") is not None
        tag = "p"
        if self.styles and (m := _HEADING.match(name)):
            tag = "h" + m[1]
        elif self.styles and listed:
            tag = "li"
        elif name and name != "Normal":
            self.messages.setdefault(f"Unrecognised paragraph style: '{name}'")
        body = self.inline(p)
        return f"<{tag}>{body}</{tag}>" if body else ""

    def blocks(self, parent) -> str:
        out = []
        for x in parent:
            if x.tag == _W + "p":
                out.append(self.paragraph(x))
            elif x.tag == _W + "tbl":
                rows = ("".join(f"<td>{self.blocks(c)}</td>" for c in r.findall(_W + "tc")) for r in x.findall(_W + "tr"))
                out.append("<table>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>")
            elif x.tag in (_W + "sdt", _W + "sdtContent", _W + "ins"):
                out.append(self.blocks(x))
        return re.sub(r"((?:<li>.*?</li>)+)", r"<ul>\1</ul>", "".join(out))


def docx_html(document: bytes, relations: str | None = None, styles: bool = False) -> tuple[str, list[tuple[str, str]]]:
    """HTML of a document part, and messages (type, text)."""
    if b"<!DOCTYPE" in document[:2048] or b"<!ENTITY" in document:
        raise ValueError("document type declarations are not read")
    reader = _Reader(relations, styles)
    body = ElementTree.fromstring(document).find(_W + "body")
    html = reader.blocks(body) if body is not None else ""
    return html, [("warning", m) for m in reader.messages]


def read_docx(parts: DataFrame, id_col: str = "id", styles: bool = False) -> DataFrame:
    """Rows (id, html, messages, error) for parts (document, relations) of ``zip_directory``."""
    kind = dict(parts.dtypes)[id_col]

    def read(batches):
        for batch in batches:
            rows = []
            for document, relations in zip(batch.column("document").to_pylist(), batch.column("relations").to_pylist(), strict=True):
                try:
                    html, messages = docx_html(document or b"", relations, styles)
                    rows.append((html, [{"type": t, "message": m} for t, m in messages], None))
                except Exception as e:  # one document must not end the job
                    rows.append((None, None, f"{type(e).__name__}: {e}"[:500]))
            types = [pa.string(), pa.list_(pa.struct([("type", pa.string()), ("message", pa.string())])), pa.string()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[id_col, "html", "messages", "error"])

    return parts.select(id_col, "document", "relations").mapInArrow(read, f"{id_col} {kind}, html string, messages array<struct<type:string,message:string>>, error string")
