"""Registered queries of HTML blocks: pages as they are, and pages put together from parts whose Markdown SQL can state."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchmint.operators.html_blocks import blocks_to_markdown, html_blocks
from parchmint.operators.layout import dealt
from parchmint.plans.queries import WS, _decoded, query
from parchmint.plans.views import table


def _trimmed(sql: str) -> str:
    return f"regexp_replace({sql}, '^{WS}+|{WS}+$', '', 'g')"


@query(
    "html_blocks",
    f"""WITH heads AS (SELECT page_id, unnest(regexp_extract_all(html, '<h([1-6])[^>]*>([^<]+)</h[1-6]>', 1)) AS level, unnest(regexp_extract_all(html, '<h([1-6])[^>]*>([^<]+)</h[1-6]>', 2)) AS spelt FROM pages),
    lists AS (SELECT page_id, unnest(regexp_extract_all(html, '<ul>(.*?)</ul>', 1, 's')) AS items FROM pages),
    shown AS (SELECT page_id, list_transform(regexp_extract_all(items, '<li>(.*?)</li>', 1, 's'), lambda i: {_trimmed(_decoded("regexp_replace(i, '<[^>]*>', '', 'g')"))}) AS items FROM lists)
    SELECT page_id, 'h' || level AS kind, chr(10) || repeat('#', level::INT) || ' ' || {_trimmed(_decoded('spelt'))} || chr(10) AS markdown FROM heads WHERE {_trimmed(_decoded('spelt'))} <> ''
    UNION ALL SELECT page_id, 'ul', chr(10) || coalesce(array_to_string(list_transform(list_filter(items, lambda i: i <> ''), lambda i: '- ' || i || chr(10)), ''), '') || chr(10) FROM shown""",
)
def blocks(spark, d):
    found = html_blocks(table(spark, d, "pages").select("page_id", "html"), "page_id", clean=False)
    return found.where("kind = 'ul' OR (kind RLIKE '^h[1-6]$' AND markdown <> '')").select("page_id", "kind", "markdown")


_MADE = """concat('<h', 1 + p_partkey % 6, '> ', p_name, ' &amp; more</h', 1 + p_partkey % 6, '><p>made of <b>', p_type, '</b><br> &#38; <i>sold</i></p>',
    '<div>by <p>', p_brand, '</p><script>x</script></div><ul><li>', p_type, '</li><li> </li><li><a href="https://h/">', p_brand, '</a><ul><li>inner</li></ul></li></ul><ol><li>', p_size, '</li><li>second</li></ol>',
    '<table><tr><th>key</th><th>a|b</th></tr><tr><td></td><td> </td></tr><tr><td>', p_partkey, '</td><td>', p_name, '</td></tr></table><blockquote>', p_name, chr(10), p_brand, '</blockquote><hr><pre> ', p_size, chr(10), 'x</pre>',
    '<strong>', p_brand, '</strong><em> </em><code> c</code><a href="', CASE p_partkey % 3 WHEN 0 THEN 'https://h.org/x?a=1&amp;b=2' WHEN 1 THEN 'javascript:alert(1)' ELSE '/local' END, '">', p_name, '</a><del>no</del>')"""


#: Tokens of such a page, about. A small file becomes many rows: the parts are dealt out first, and a part's windows find it there.
_MADE_TOKENS = 120


@query(
    "html_made_markdown",
    """SELECT p_partkey, repeat('#', (1 + p_partkey % 6)::INT) || ' ' || p_name || ' & more' || chr(10) || chr(10) || 'made of ' || p_type || ' & sold' || chr(10) || 'by ' || p_brand || 'x' || chr(10)
        || '- ' || p_type || chr(10) || '- ' || p_brand || 'inner' || chr(10) || chr(10) || '1. ' || p_size || chr(10) || '2. second' || chr(10) || chr(10)
        || '| key | a\\|b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_partkey || ' | ' || p_name || ' |' || chr(10) || chr(10) || '> ' || p_name || chr(10) || '> ' || p_brand || chr(10) || chr(10) || '---' || chr(10) || chr(10)
        || '```' || chr(10) || ' ' || p_size || chr(10) || 'x' || chr(10) || '```' || chr(10) || '**' || p_brand || '**' || '` c`'
        || CASE p_partkey % 3 WHEN 0 THEN '[' || p_name || '](https://h.org/x?a=1&b=2)' ELSE p_name END || '~~no~~' AS markdown FROM part""",
)
def made_markdown(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    pages = dealt(parts, ["p_partkey"], parts.count() * _MADE_TOKENS).select("p_partkey", F.expr(_MADE.replace("chr(10)", "char(10)")).alias("html"))
    return blocks_to_markdown(pages, "p_partkey")
