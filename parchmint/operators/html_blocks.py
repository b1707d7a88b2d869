"""HTML to Markdown as relations: tokens of a page, the blocks they stand in, and the blocks' text.

Tokens are rows, nesting is running sums over a page's tokens, and blocks are groups; no page is
one value before its Markdown is put together, and no Python runs. Lists, tables, quotations and preformatted text
must be closed where they end; paragraphs and headings also end where the next block begins. The tree of
``html_markdown`` has all ends that browsers supply, and is the reader for damaged pages.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.functions.text import WS
from parchmint.operators.html_markdown import ALLOWED

_RAW = r"<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>"
TOKEN = rf"(?is)<!--.*?-->|<title\b[^>]*>.*?</title\s*>|{_RAW}|<[a-z/!?][^>]*>|[^<]+|<"
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
_NESTING = ("ul", "ol", "table", "pre", "blockquote")
_HEADS = tuple(f"h{i}" for i in range(1, 7))
_INLINE = ("strong", "b", "em", "i", "del", "s", "code", "a")
#: Tags that end a paragraph, besides those of blocks.
_ENDS = ("address", "article", "aside", "body", "center", "details", "div", "dl", "fieldset", "figure", "footer", "form", "header", "hr", "main", "menu", "nav", "section")
_MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~"}
SAFE_LINK = r"(?i)^\s*(?:https?://[^/?#\s]|mailto:)"


_NAMES = "map(" + ", ".join(f"'{name}', decode(unhex('{point:08X}'), 'UTF-32')" for name, point in name2codepoint.items()) + ")"


def decoded(text: Column) -> Column:
    """Text with its character references replaced: decimal, hexadecimal, and the named ones of HTML 4. Others stay."""
    names = F.expr(_NAMES)

    def character(code: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")

    def one(part: Column) -> Column:
        name = F.regexp_extract(part, r"^([A-Za-z][A-Za-z0-9]*|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});", 1)
        point = F.when(name.rlike("^#[0-9]"), F.try_to_number(F.substring(name, F.lit(2), F.length(name)), F.lit("9999999")).cast("long")).when(name.rlike("^#[xX]"), F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10).cast("long"))
        known = F.when(point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF), character(point)).otherwise(F.try_element_at(names, name))
        return F.when((name != "") & known.isNotNull(), F.concat(known, F.substring(part, F.length(name) + 2, F.length(part)))).otherwise(F.concat(F.lit("&"), part))

    parts = F.split(text, "&", -1)
    rest = F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one), "")
    return F.when(text.contains("&"), F.concat(parts[0], rest)).otherwise(text)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def html_tokens(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Rows (key, pos, token, tag, opens, closes, text): text is null for tags, and for comments and titles, which have no tag."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    token = F.col("token")
    raw = token.rlike(rf"(?is)^{_RAW}\z")
    dropped = token.rlike(r"(?i)^<(?:!|\?|title\b)")
    tag = F.when(raw | dropped, "").otherwise(F.lower(F.regexp_extract(token, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1)))
    text = F.when(raw, F.regexp_extract(token, r"(?is)^<[^>]*>(.*)</[^<]*\z", 1)).when(~dropped & (tag == ""), decoded(token))
    void = F.col("tag").isin(*_VOID)
    out = rows.withColumns({"tag": tag, "text": text})
    return out.withColumns({"opens": (F.col("tag") != "") & ~token.startswith("</") & ~void & ~token.endswith("/>"), "closes": (F.col("tag") != "") & token.startswith("</") & ~void})


def html_blocks(pages: DataFrame, key: str, html: str = "html", clean: bool = True) -> DataFrame:
    """Rows (key, block, kind, markdown): the blocks of each page in order; kind is the block's tag, or plain.

    With ``clean`` an element that is not allowed is its text alone, and links keep only safe absolute addresses.
    """
    here = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = Window.partitionBy(key, "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    tag = F.col("tag")

    def nesting(of: Column, within=here) -> Column:
        return F.sum(F.when(of & F.col("opens"), 1).when(of & F.col("closes"), -1).otherwise(0)).over(within)

    rows = html_tokens(pages, key, html)
    barred = (tag != "") & ~tag.isin(*sorted(ALLOWED)) & ~tag.isin(*_VOID) if clean else F.lit(False)
    rows = rows.withColumn("barred", nesting(barred))
    # Tags within a barred element count for nothing; its own two tags bound one run of text.
    free = (F.col("barred") == 0) & ~barred
    rows = rows.withColumn("bars", barred & F.col("opens") & (F.col("barred") == 1)).withColumns({"opens": F.col("opens") & free, "closes": F.col("closes") & free, "tag": F.when(free, tag).otherwise("")})
    rows = rows.withColumn("outer", nesting(tag.isin(*_NESTING)))
    before = F.col("outer") - F.when(tag.isin(*_NESTING), F.col("opens").cast("int") - F.col("closes").cast("int")).otherwise(0)
    single = tag.isin("p", *_HEADS)
    begins = ((before == 0) & (tag.isin(*_NESTING) | single) & F.col("opens")) | ((before == 0) & ((single & F.col("closes")) | tag.isin(*_ENDS))) | ((before == 1) & (F.col("outer") == 0))
    rows = rows.withColumn("begins", F.coalesce(begins, F.lit(False))).withColumn("block", F.sum(F.col("begins").cast("int")).over(here))
    kind = F.when(F.col("begins") & F.col("opens") & (tag.isin(*_NESTING) | single), tag)
    rows = rows.withColumn("kind", F.coalesce(F.max(kind).over(inside), F.lit("plain")))

    rows = rows.withColumns({"lists": nesting(tag.isin("ul", "ol"), inside), "inline": nesting(tag.isin(*_INLINE), inside)})
    inline_opens = tag.isin(*_INLINE) & F.col("opens") & (F.col("inline") == 1)
    outside = (F.col("inline") == 0) & (F.col("barred") == 0)
    unit = (
        F.when(F.col("kind").isin("ul", "ol"), (tag == "li") & F.col("opens") & (F.col("lists") == 1))
        .when(F.col("kind") == "table", tag.isin("td", "th") & F.col("opens"))
        .when(F.col("kind") == "plain", inline_opens | (outside & (F.col("text").isNotNull() | tag.isin("br", "hr"))) | (F.col("bars") & (F.col("inline") == 0)))
        .otherwise(F.lit(False))
    )
    rows = rows.withColumn("_u", unit.cast("int")).withColumns({"unit": F.sum("_u").over(inside), "row": F.sum(((tag == "tr") & F.col("opens")).cast("int")).over(inside)})
    href = F.regexp_extract("token", r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    href = F.when(inline_opens & (tag == "a"), decoded(F.regexp_replace(F.regexp_replace(href, r"(?is)^\shref\s*=\s*", ""), r"""^["']|["']\z""", ""))).otherwise("")
    first = F.struct("pos", tag.alias("tag"), href.alias("href"))
    units = rows.groupBy(key, "block", "kind", "unit").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("pos", "text")))), lambda t: t["text"]), "").alias("text"),
        F.min("row").alias("row"), F.min(F.when(F.col("_u") == 1, first)).alias("first"),
    )
    return _rendered(units, key, clean)


def _rendered(units: DataFrame, key: str, clean: bool) -> DataFrame:
    """Blocks from their units: list items, cells, runs of inline text, or the one text of any other block."""
    text, stripped, tag = F.col("text"), _strip(F.col("text")), F.col("first.tag")
    href = F.col("first.href")
    linked = (href != "") & (href.rlike(SAFE_LINK) if clean else F.lit(True))
    run = (
        F.when(tag == "br", "\n").when(tag == "hr", "\n---\n").when((tag == "code") & (text != ""), F.concat(F.lit("`"), text, F.lit("`")))
        .when((tag == "a") & (stripped != "") & linked, F.concat(F.lit("["), stripped, F.lit("]("), href, F.lit(")")))
    )
    for name, mark in _MARKS.items():
        run = run.when((tag == name) & (stripped != ""), F.concat(F.lit(mark), stripped, F.lit(mark)))
    run = run.otherwise(stripped)
    shown = F.when(F.col("kind") == "plain", run).when(F.col("kind").isin("ul", "ol", "table"), F.replace(stripped, F.lit("|"), F.when(F.col("kind") == "table", "\\|").otherwise("|"))).otherwise(text)
    # What stands between a list's or table's tag and its first item or cell is no unit of it.
    used = ~F.col("kind").isin("ul", "ol", "table") | (F.col("unit") > 0)
    blocks = units.groupBy(key, "block", "kind").agg(F.array_sort(F.collect_list(F.when(used, F.struct("unit", "row", shown.alias("text"))))).alias("units"))

    items = F.filter(F.transform("units", lambda u: u["text"]), lambda t: t != "")
    listed = F.transform(items, lambda t, i: F.concat(F.when(F.col("kind") == "ol", F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("- "), t, F.lit("\n")))
    lists = F.concat(F.lit("\n"), F.array_join(listed, ""), F.lit("\n"))
    numbers = F.array_sort(F.array_distinct(F.transform("units", lambda u: u["row"])))
    cells = F.transform(numbers, lambda r: F.transform(F.filter("units", lambda u: u["row"] == r), lambda u: u["text"]))
    line = lambda c: F.concat(F.lit("| "), F.array_join(c, " | "), F.lit(" |\n"))
    body = F.filter(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), lambda c: F.exists(c, lambda t: t != ""))
    first = F.get(cells, F.lit(0))
    drawn = F.concat(F.lit("\n"), line(first), line(F.transform(first, lambda _: F.lit("---"))), F.array_join(F.transform(body, line), ""), F.lit("\n"))
    table = F.when(F.size("units") > 0, drawn).otherwise("\n")
    whole = F.array_join(F.transform("units", lambda u: u["text"]), "")
    inner = _strip(whole)
    mark = F.when(F.col("kind").rlike("^h[1-6]$"), F.concat(F.repeat(F.lit("#"), F.substring("kind", 2, 1).cast("int")), F.lit(" "))).otherwise("")
    markdown = (
        F.when(F.col("kind") == "plain", whole).when(F.col("kind").isin("ul", "ol"), lists).when(F.col("kind") == "table", table)
        .when(F.col("kind") == "pre", F.when(whole != "", F.concat(F.lit("\n```\n"), whole, F.lit("\n```\n"))).otherwise(""))
        .when(inner == "", "").when(F.col("kind") == "blockquote", F.concat(F.lit("\n> "), F.replace(inner, F.lit("\n"), F.lit("\n> ")), F.lit("\n")))
        .otherwise(F.concat(F.lit("\n"), mark, inner, F.lit("\n")))
    )
    return blocks.select(key, "block", "kind", markdown.alias("markdown"))


def blocks_to_markdown(pages: DataFrame, key: str, html: str = "html", clean: bool = True) -> DataFrame:
    """Rows (key, markdown): the blocks of each page, one after another."""
    parts = F.array_sort(F.collect_list(F.struct("block", "markdown")))
    joined = html_blocks(pages, key, html, clean).groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["markdown"]), "").alias("_all"))
    found = joined.select(key, _strip(F.regexp_replace("_all", "\n{3,}", "\n\n")).alias("markdown"))
    return pages.select(key).join(found, key, "left").select(key, F.coalesce("markdown", F.lit("")).alias("markdown"))
