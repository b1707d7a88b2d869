"""Embedded text of simple PDF files as positioned items.

Reads indirect objects, those of object streams too, Flate streams, the page tree,
and the text operators of content streams. Fonts with a ``ToUnicode`` map are decoded by
it, others as Windows Latin. Widths are those of an average letter. Encrypted files
are reported, not read.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from parchmint.operators.deadlines import OutOfTime, within
from parchmint.options import TIMED_OUT

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_NUMBERS = rb"[-+]?\d*\.?\d+"
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|" + _NUMBERS + rb"|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": "\n", b"r": "\r", b"t": "\t", b"b": "\b", b"f": "\f"}
ITEMS = "array<struct<page_no:int,item_idx:int,str:string,x:double,y:double,height:double,width:double,font_name:string,bold:boolean>>"
GEOMETRY = "array<struct<page_no:int,width:double,height:double>>"


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def plain(m: re.Match) -> bytes:
        c = m[1]
        if c.isdigit():
            return bytes([int(c, 8) & 255])
        return _ESCAPES[c].encode() if c in _ESCAPES else (b"" if c in (b"\n", b"\r") else c)

    return re.sub(rb"\\([0-7]{1,3}|.)", plain, token[1:-1], flags=re.S)


def _code_map(spelt: bytes) -> tuple[int, dict[int, str]]:
    """Bytes of a code, and the text of each, of a ``ToUnicode`` map."""

    def text(digits: bytes) -> str:
        return bytes.fromhex(digits.decode()).decode("utf-16-be", "replace")

    size = max((len(m[1]) // 2 for m in re.finditer(rb"<([0-9A-Fa-f]+)>\s*<[0-9A-Fa-f]+>\s*endcodespacerange", spelt)), default=1)
    found: dict[int, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", spelt, re.S):
        found |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", spelt, re.S):
        for a, b, c, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", block):
            listed = re.findall(rb"<([0-9A-Fa-f]+)>", many)
            for k in range(min(int(b, 16) - int(a, 16) + 1, 1 << 16)):
                if c:
                    base = text(c)
                    found[int(a, 16) + k] = base[:-1] + chr(ord(base[-1]) + k) if base else ""
                elif k < len(listed):
                    found[int(a, 16) + k] = text(listed[k])
    return size, found


def _decoded(raw: bytes, codes: tuple[int, dict[int, str]] | None) -> str:
    if not codes:
        return raw.decode("cp1252", "replace")
    size, found = codes
    return "".join(found.get(int.from_bytes(raw[i : i + size], "big"), "") for i in range(0, len(raw), size))


def _text_items(content: bytes, fonts: dict[str, str], maps: dict[str, tuple] | None = None) -> list[dict]:
    items, args, array, codes = [], [], None, maps or {}
    size, leading, name = 0.0, 0.0, ""
    line, pos = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], [0.0, 0.0]

    def move(x: float, y: float) -> None:
        line[4] += x * line[0] + y * line[2]
        line[5] += x * line[1] + y * line[3]
        pos[:] = [line[4], line[5]]

    def show(text: str) -> None:
        height = abs(size * line[3]) or abs(size)
        width = 0.5 * height * len(text)
        if text:
            items.append({"str": text, "x": pos[0], "y": pos[1], "height": height, "width": width, "font_name": fonts.get(name, name)})
        pos[0] += width

    for m in _TOKEN.finditer(content):
        t = m[0]
        c = t[:1]
        if t == b"[":
            array = []
        elif t == b"]":
            args.append(array or [])
            array = None
        elif c in b"(<":
            (args if array is None else array).append(_string(t))
        elif c == b"/":
            args.append(t[1:].decode("latin-1"))
        elif re.fullmatch(_NUMBERS, t):
            (args if array is None else array).append(float(t))
        else:
            if t == b"BT":
                line[:], pos[:] = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], [0.0, 0.0]
            elif t == b"Tf" and len(args) >= 2:
                name, size = str(args[-2]), float(args[-1])
            elif t == b"TL" and args:
                leading = float(args[-1])
            elif t in (b"Td", b"TD") and len(args) >= 2:
                if t == b"TD":
                    leading = -float(args[-1])
                move(float(args[-2]), float(args[-1]))
            elif t == b"Tm" and len(args) >= 6:
                line[:] = map(float, args[-6:])
                pos[:] = line[4:]
            elif t == b"T*":
                move(0, -leading)
            elif t in (b"Tj", b"'", b'"') and args:
                if t != b"Tj":
                    move(0, -leading)
                show(_decoded(args[-1], codes.get(name)) if isinstance(args[-1], bytes) else str(args[-1]))
            elif t == b"TJ" and args and isinstance(args[-1], list):
                show("".join(_decoded(x, codes.get(name)) if isinstance(x, bytes) else " " if x < -200 else "" for x in args[-1]))
            args = []
    return items


def _inflate(data: bytes, limit: int) -> bytes:
    machine = zlib.decompressobj()
    out = machine.decompress(data, limit)
    if machine.unconsumed_tail and machine.decompress(machine.unconsumed_tail, 1):
        raise ValueError(f"a stream is over the limit of {limit} bytes")
    return out


def _unpacked(objects: dict[int, bytes], limit: int) -> None:
    """Add the objects that object streams hold; later definitions in the file stay."""
    for body in list(objects.values()):
        m = _STREAM.match(body)
        if not m or not re.search(rb"/Type\s*/ObjStm\b", m[1]):
            continue
        first, count = (re.search(rb"/" + key + rb"\s+(\d+)", m[1]) for key in (b"First", b"N"))
        if not first or not count or b"DecodeParms" in m[1]:
            continue
        data = _inflate(m[2], limit) if b"FlateDecode" in m[1] else m[2]
        head = [int(x) for x in data[: int(first[1])].split()[: 2 * int(count[1])]]
        starts = [int(first[1]) + x for x in head[1::2]]
        for number, begin, end in zip(head[::2], starts, [*starts[1:], len(data)], strict=False):
            objects.setdefault(number, data[begin:end])


#: A trailer's dictionary, which alone tells of encryption (a cross-reference stream's does where there is no trailer).
_TRAILER = re.compile(rb"trailer\s*(<<.*?)(?:startxref|%%EOF|\Z)", re.S)


def read_pdf(data: bytes, limit: int = 1 << 27) -> tuple[list[dict], list[dict]]:
    """Pages (page_no, width, height) and items (page_no, item_idx, ...) of a file; a stream over ``limit`` bytes is an error."""
    if data[:5] != b"%PDF-":
        raise ValueError("invalid header")
    objects = {int(m[1]): m[3] for m in _OBJECT.finditer(data)}
    tables = [m[1] for m in _TRAILER.finditer(data)] + [b.split(b"stream", 1)[0] for b in objects.values() if re.search(rb"/Type\s*/XRef\b", b[:4096])]
    if any(re.search(rb"/Encrypt\b", t) for t in tables):
        raise PermissionError("password or encryption")
    if not objects:
        raise ValueError("corrupt: no objects")
    _unpacked(objects, limit)

    def refs(key: bytes, body: bytes) -> list[int]:
        m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []

    def stream(number: int) -> bytes:
        m = _STREAM.match(objects.get(number, b""))
        if not m:
            return b""
        return _inflate(m[2], limit) if b"FlateDecode" in m[1] else m[2]

    def box(body: bytes) -> list[float] | None:
        m = re.search(rb"/MediaBox\s*\[\s*(" + _NUMBERS + rb")\s+(" + _NUMBERS + rb")\s+(" + _NUMBERS + rb")\s+(" + _NUMBERS + rb")", body)
        return [float(x) for x in m.groups()] if m else None

    pages: list[tuple[bytes, list[float] | None]] = []
    catalog = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
    todo = [(n, None) for n in reversed(refs(b"Pages", catalog))]
    seen: set[int] = set()
    while todo:
        number, above = todo.pop()
        body = objects.get(number, b"")
        if number in seen:
            continue
        seen.add(number)
        own = box(body) or above
        if re.search(rb"/Type\s*/Pages\b", body):
            todo += [(n, own) for n in reversed(refs(b"Kids", body))]
        elif re.search(rb"/Type\s*/Page\b", body):
            pages.append((body, own))
    geometry, items = [], []
    for number, (body, area) in enumerate(pages, 1):
        x0, y0, x1, y1 = area or [0, 0, 612, 792]
        geometry.append({"page_no": number, "width": x1 - x0, "height": y1 - y0})
        names = dict(re.findall(rb"/([^\s/\[\]()<>]+)\s+(\d+)\s+\d+\s+R", body))
        fonts = {k.decode("latin-1"): m[1].decode("latin-1") for k, n in names.items() if (m := re.search(rb"/BaseFont\s*/([^\s/\[\]()<>]+)", objects.get(int(n), b"")))}
        maps = {k.decode("latin-1"): _code_map(stream(m[0])) for k, n in names.items() if (m := refs(b"ToUnicode", objects.get(int(n), b"")))}
        content = b"\n".join(stream(n) for n in refs(b"Contents", body))
        bold = {f: bool(re.search("bold", f, re.I)) for f in fonts.values()}
        items += [{"page_no": number, "item_idx": i, **item, "bold": bold.get(item["font_name"], "bold" in item["font_name"].lower())} for i, item in enumerate(_text_items(content, fonts, maps))]
    if any("\x00" in item["str"] for item in items):
        raise ValueError("a font of two-byte codes has no map to text")
    return geometry, items


def read_pdfs(files: DataFrame, id_col: str = "id", content_col: str = "content", limit: int = 1 << 27, max_ms: int | None = None) -> DataFrame:
    """Rows (id, pages, items, error_name, error) for files; explode pages and items for tables of them.

    A file that takes more than ``max_ms`` to read has the error name ``TimeoutException``.
    """
    kind = dict(files.dtypes)[id_col]

    def read(batches):
        item = pa.struct([("page_no", pa.int32()), ("item_idx", pa.int32()), ("str", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("height", pa.float64()), ("width", pa.float64()), ("font_name", pa.string()), ("bold", pa.bool_())])
        page = pa.struct([("page_no", pa.int32()), ("width", pa.float64()), ("height", pa.float64())])
        for batch in batches:
            rows = []
            for content in batch.column(content_col).to_pylist():
                try:
                    with within(max_ms):
                        rows.append((*read_pdf(content or b"", limit), None, None))
                except OutOfTime:
                    rows.append((None, None, "TimeoutException", TIMED_OUT))
                except Exception as e:  # one file must not end the job
                    rows.append((None, None, "PasswordException" if isinstance(e, PermissionError) else "InvalidPDFException", str(e)[:500]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *(pa.array(c, t) for c, t in zip(columns, [pa.list_(page), pa.list_(item), pa.string(), pa.string()], strict=True))], names=[id_col, "pages", "items", "error_name", "error"])

    return files.select(id_col, content_col).mapInArrow(read, f"{id_col} {kind}, pages {GEOMETRY}, items {ITEMS}, error_name string, error string")
