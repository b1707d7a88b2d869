"""Scalar string rules as Column expressions; lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchmint.options import COMPOUND_PREFIXES, PDF_ERRORS, TRUNCATED

#: White space of the documents' own rules: ASCII, no-break and other Unicode spaces, and the byte order mark.
WS = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: The same characters, as a string.
BLANKS = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: What is not white space.
INK = "[^" + WS[1:]


def trim_all(s: Column) -> Column:
    return F.regexp_replace(s, f"^{WS}+|{WS}+\\z", "")


def collapse(s: Column) -> Column:
    """Runs of white space become one space, none at the ends; what is one space already is no match."""
    return F.trim(F.regexp_replace(s, f"{WS.replace(' ', '')}{WS}*| {WS}+", " "))


def sanitize_filename(raw: Column) -> Column:
    s = F.regexp_replace(raw, r"[\x00-\x1f\x7f]", "")
    s = F.regexp_replace(s, r"[^A-Za-z0-9._\- ]", "_")
    s = F.substring(F.trim(F.regexp_replace(s, " +", " ")), 1, 200)
    return F.coalesce(F.when(s != "", s), F.lit("document"))


def name_without_ext(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.(pdf|docx)\z", "")


def format_size(size: Column) -> Column:
    return F.when(size >= 1048576, F.format_string("%.1f MB", size / F.lit(1048576.0))).otherwise(F.format_string("%.0f KB", size / F.lit(1024.0)))


#: Links to script and HTML data addresses.
LINK = rf"\[([^\]]*)\]\({WS}*(?i:javascript:|data:text/html)[^)]*\)"
#: A text whose end may be the beginning of a link that loses its address.
OPEN_LINK = rf"(?s)\[[^\]]*(?:\](?:\({WS}*(?:[a-zA-Z:/]{{0,13}}|(?i:javascript:|data:text/html)[^)]*))?)?\z"


def sanitize_links(md: Column) -> Column:
    """Links to script and HTML data addresses lose their address."""
    return F.regexp_replace(md, LINK, "[$1]()")


def classify_error(message: Column, name: Column) -> Column:
    message, name = F.coalesce(message, F.lit("")), F.coalesce(name, F.lit(""))
    return (
        F.when(message.rlike("(?i)password|encrypt") | (name == "PasswordException"), PDF_ERRORS["password"])
        .when(message.rlike("(?i)invalid|corrupt|malformed") | name.rlike("(?i)UnknownErrorException|InvalidPDFException"), PDF_ERRORS["corrupt"])
        .when(message.rlike("(?i)out of memory|memory"), PDF_ERRORS["memory"])
        .otherwise(PDF_ERRORS["other"])
    )


def escape_pipes(s: Column) -> Column:
    return F.replace(s, F.lit("|"), F.lit("\\|"))


def collapse_newlines(s: Column) -> Column:
    return F.regexp_replace(s, "\n{3,}", "\n\n")


def blockquote(s: Column) -> Column:
    return F.array_join(F.transform(F.split(s, "\n", -1), lambda line: F.concat(F.lit("> "), line)), "\n")


def truncate(md: Column, limit: int) -> Column:
    return F.when(F.length(md) > limit, F.concat(F.substring(md, 1, limit), F.lit(TRUNCATED))).otherwise(md)


def all_caps(t: Column) -> Column:
    letters = F.regexp_replace(t, "[^A-Za-z]", "")
    return letters.rlike(r"^[A-Z]{3,}\z")


def heading_level(text: Column, h: Column, modal: Column) -> Column:
    """1 to 3 for a heading, 0 for other text; the first rule that holds decides. A rule looks at the text last."""
    size = F.length(text)
    return (
        F.when((text == "") | text.isNull(), 0)
        .when(h >= modal * F.lit(1.35), 1)
        .when((h >= modal * F.lit(1.05)) & text.rlike(rf"^[IVXLC]{{1,5}}\.{WS}+{INK}"), 2)
        .when((h >= modal * F.lit(1.12)) & (size < 60) & text.rlike(rf"^[0-9]{{1,2}}\.{WS}+[A-Z]"), 2)
        .when((h >= modal * F.lit(1.05)) & text.rlike(rf"^(?i:Exhibit){WS}+[A-Za-z0-9]"), 2)
        .when((h >= modal * F.lit(1.03)) & (size <= 45) & all_caps(text), 2)
        .when((h >= modal) & (size < 75) & text.rlike(rf"^[A-Z]\.{WS}+{INK}"), 3)
        .when(h >= modal * F.lit(1.22), 2)
        .when(h >= modal * F.lit(1.1), 3)
        .otherwise(0)
    )


def list_marker(text: Column) -> Column:
    """A struct (kind, body): kind ul, ol or null."""
    bullet, number = rf"^[•\-*·○–]{WS}+([^\n\r\x{{2028}}\x{{2029}}]*)\z", rf"^(?:[0-9]+\.|\([A-Za-z0-9]+\)){WS}+([^\n\r\x{{2028}}\x{{2029}}]*)\z"
    kind = F.when(text.rlike(bullet), "ul").when(text.rlike(number), "ol")
    body = F.when(kind == "ul", F.regexp_extract(text, bullet, 1)).when(kind == "ol", F.regexp_extract(text, number, 1))
    return F.struct(kind.alias("kind"), body.alias("body"))


def hyphen_stem(text: Column) -> Column:
    """The word before a hyphen that ends the text, lower-cased; null without one."""
    return F.when(text.rlike(r"[A-Za-z]-\z"), F.lower(F.regexp_extract(text, rf"({INK}+)-\z", 1)))


def keeps_hyphen(stem: Column) -> Column:
    return stem.isin(*COMPOUND_PREFIXES)


def mime_type(path: Column) -> Column:
    """Type of a file by its extension, for files written or served."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)\z", 1))
    kinds = {".md": "text/markdown", ".html": "text/html", ".json": "application/json", ".js": "text/javascript", ".css": "text/css", ".wasm": "application/wasm", ".png": "image/png"}
    out = F.when(F.lit(False), "")
    for k, v in kinds.items():
        out = out.when(ext == k, v)
    return out.otherwise("application/octet-stream")
