"""Main text of web pages: nearest-URL differencing over blocks of lines.

A page is cut into blocks at block-level tags; scripts, styles, comments and
markup go, references are decoded. Elements that name themselves as menus,
headers, footers, sidebars, notices, adverts, forms or comments are furniture.
Pages are ordered by host and path, so each is compared with the nearest
URLs of its host, of which copies are passed over; lines of the two are aligned by
longest common subsequence and, where no article is marked, lines that half of the nearest share deleted.
Lines outside a marked article are left out without a comparison. Two pages that quote
one passage share it too, and it is no furniture, so a line inside a marked article
goes only when it is short and the nearest four pages that differ have it as well.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.neighbours import with_neighbours

#: The rest of a tag up to its end, or to that of the page: every match takes what it has read, so a scan is linear.
_REST = r"(?>[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(script|style|title|textarea|noscript|iframe|xmp|noframes|noembed)\b{_REST}(?:>|\Z).*?(?:</\1\s*>|\Z)"
    r"|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    rf"|<([a-zA-Z][^\s/>]*+)({_REST})(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/>]+)")
_PARTS = re.compile(r"[^a-z0-9]+")
#: Fixed lists: tags without content, tags that end a line of text, tags and names of furniture, names of article bodies.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
WALLS = frozenset("article body main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE_TAGS = frozenset("aside audio button canvas datalist dialog fieldset footer form head header math menu nav object search select svg template video".split())
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login "
    "masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related replies reply "
    "share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget alert warning".split()
)
FURNITURE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
ARTICLE_NAMES = frozenset("article article-body article-content articlebody content entry-content main main-content post post-body post-content story story-body".split())
#: First parts of names that tell of a layout, and whether something stands in it, rather than name what the element is.
STATES = frozenset("has have is no not show with without".split())
COPY_SHARE = 0.8
#: Bits of a table of common subsequences that are held at once.
TABLE_BITS = 1 << 28
#: A line of a marked article goes when so many other pages nearby have it in theirs, and it has at most so many characters.
WITNESSES, SHORT_LINE = 4, 200
Line = tuple[str, int, bool]


def _attributes(spelt: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(spelt)} if spelt.strip() else {}


def _place(tag: str, spelt: str, level: int, furniture: int) -> tuple[int, int]:
    """How surely an element's lines belong to the article (0 to 3), and how surely they are furniture (0 to 3).

    3: the tag, the role, a whole name or being hidden says so. 2: only a part of a longer name does.
    1: an article inside such an element, which is the page's where there is no other.
    """
    found = _attributes(spelt)
    names = {n for k in ("class", "id") for n in found.get(k, "").lower().split()}
    split = [[p for p in _PARTS.split(n) if p] for n in names]
    parts = {p for n in split if n and n[0] not in STATES for p in n}
    if tag in ("html", "body"):
        return level, furniture
    hidden = 3 * ("hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower())
    if tag == "article" and not parts & {"comment", "comments", "reply", "ad", "ads", "advert", "promo", "related"}:
        return 3, max(1 if furniture == 2 else furniture, hidden)
    if tag == "main" or found.get("role") == "main":
        return max(level, 2), max(1 if furniture == 2 else furniture, hidden)
    if level or tag in HEADINGS:
        parts.discard("header")  # an article's own head holds its title
    inside_head = tag == "header" and level == 3
    if (tag in FURNITURE_TAGS and not inside_head) or names & FURNITURE_NAMES & parts or found.get("role") in FURNITURE_ROLES or hidden:
        return level, 3
    if parts & FURNITURE_NAMES:
        return level, max(furniture, 2)
    if found.get("itemprop") == "articleBody" or names & ARTICLE_NAMES:
        return max(level, 1), furniture
    return level, furniture


def page_lines(html: str) -> list[Line]:
    """Lines (text, level, furniture) of a page in order, white space collapsed, empty ones left out."""
    lines: list[tuple[str, int, int]] = []
    stack: list[tuple[str, int, int, bool]] = []
    places: dict[str, list[int]] = {}  # of the open elements of each tag in the stack
    walls: list[int] = []  # places of the elements that a stray end tag does not leave
    level, furniture, muted, buffer, at = 0, 0, False, [], 0  # muted: in furniture that stands inside a line

    def close() -> None:
        text = " ".join("".join(buffer).split())
        if text:
            lines.append((text, level, furniture))
        buffer.clear()

    def leave(place: int) -> tuple[int, int, bool]:
        state = stack[place][1:]
        for tag, *_ in stack[place:]:
            places[tag].pop()
        del stack[place:]
        while walls and walls[-1] >= place:
            walls.pop()
        return state

    for m in _TOKEN.finditer(html):
        if m.start() > at and not muted:
            buffer.append(unescape(html[at : m.start()]))
        at = m.end()
        if m[3]:
            tag = m[3].lower()
            if tag in BLOCK:
                close()
                if stack and stack[-1][0] == tag and tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):
                    level, furniture, muted = leave(len(stack) - 1)
            if tag not in VOID and not m[4].endswith("/"):
                places.setdefault(tag, []).append(len(stack))
                if tag in WALLS:
                    walls.append(len(stack))
                stack.append((tag, level, furniture, muted))
                before = furniture
                level, furniture = _place(tag, m[4], level, furniture)
                muted = muted or (tag not in BLOCK and furniture >= 2 > before)
        elif m[2]:
            tag = m[2].lower()
            if tag in BLOCK:
                close()
            place = places[tag][-1] if places.get(tag) else -1
            if place >= 0 and (tag in WALLS or tag == "html" or not walls or place > walls[-1]):
                level, furniture, muted = leave(place)
    if at < len(html) and not muted:
        buffer.append(unescape(html[at:]))
    close()
    least = 1 if any(level >= 2 and not furniture for _, level, furniture in lines) else 2
    return [(text, level, furniture >= least) for text, level, furniture in lines]


def common_subsequence(one: list[str], two: list[str]) -> set[int]:
    """Indices in ``one`` of a longest common subsequence.

    Chains of equal pairs (Hunt and Szymanski) where equal pairs are few; where lines recur so
    often that they are many, bit vectors of the whole table's rows.
    """
    places: dict[str, list[int]] = {}
    for j, line in enumerate(two):
        places.setdefault(line, []).append(j)
    if sum(len(places.get(line, ())) for line in one) > 64 * (len(one) + len(two)):
        return _by_bits(one, two)
    tails: list[int] = []
    chains: list[tuple] = []
    for i, line in enumerate(one):
        for j in reversed(places.get(line, ())):
            k = bisect_left(tails, j)
            chain = (i, chains[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                chains.append(chain)
            else:
                tails[k] = j
                chains[k] = chain
    out, node = set(), chains[-1] if chains else None
    while node:
        out.add(node[0])
        node = node[1]
    return out


def _rows(one: list[str], two: list[str]) -> Iterator[int]:
    """For each prefix of ``one`` a number whose bit j is 0 where the common subsequence with ``two`` grows at j."""
    masks: dict[str, int] = {}
    for j, line in enumerate(two):
        masks[line] = masks.get(line, 0) | 1 << j
    full = (1 << len(two)) - 1
    row = full
    yield row
    for line in one:
        both = row & masks.get(line, 0)
        row = (row + both | row - both) & full
        yield row


def _lengths(one: list[str], two: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``one`` with each prefix of ``two``."""
    row = 0
    for row in _rows(one, two):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(two) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(two)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _by_bits(one: list[str], two: list[str]) -> set[int]:
    """The same by the rows of the whole table; a table over ``TABLE_BITS`` is halved at the best place until it fits."""
    out, work = set(), [(0, len(one), 0, len(two))]
    while work:
        a, b, c, d = work.pop()
        if a == b or c == d:
            continue
        if (b - a) * (d - c) > TABLE_BITS and b - a > 1:
            half = (a + b) // 2
            ahead, behind = _lengths(one[a:half], two[c:d]), _lengths(one[half:b][::-1], two[c:d][::-1])[::-1]
            cut = c + int(np.argmax(ahead + behind))
            work += [(a, half, c, cut), (half, b, cut, d)]
            continue
        rows = list(_rows(one[a:b], two[c:d]))
        i, j = b - a, d - c
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
                continue
            mask = (1 << j) - 1
            if (rows[i - 1] & mask).bit_count() == (rows[i] & mask).bit_count():
                i -= 1
            else:
                i, j = i - 1, j - 1
                out.add(a + i)
    return out


def _body(lines: list[Line]) -> int:
    """The level that holds the most text of those marked, the surer of two; 0 where none is marked."""
    mass = [0] * 4
    for text, level, furniture in lines:
        mass[level] += 0 if furniture else len(text)
    return max((1, 2, 3), key=lambda level: (mass[level], level)) if any(mass[1:]) else 0


def _others(own: list[Line], before: list[list[Line]], after: list[list[Line]]) -> list[list[Line]]:
    """The pages on either side, nearest first and the later of two first, without copies of the page or of each other."""
    seen, out = {tuple(text for text, _, _ in own)}, []
    for k in range(max(len(before), len(after))):
        for page in after[k : k + 1] + before[k : k + 1]:
            texts = tuple(text for text, _, _ in page)
            if texts not in seen:
                seen.add(texts)
                out.append(page)
    return out


def _unmarked_shared(own: list[Line], others: list[list[Line]]) -> set[int]:
    """Lines that a page without a marked article shares with half or more of the nearest ``WITNESSES`` pages that are no near copies of it.

    Where all pages nearby are near copies, as short texts under large menus look, the lines
    that it shares with all of them go, if there are two at least and something stays.
    """
    texts = [text for text, _, _ in own]
    whole = sum(map(len, texts))
    common, votes, used = set(range(len(own))), [0] * len(own), 0
    for other in others:
        top = _body(other)
        found = common_subsequence(texts, [text for text, level, _ in other if not (top and level >= top)])
        if sum(len(texts[i]) for i in found) < COPY_SHARE * whole:
            used += 1
            for i in found:
                votes[i] += 1
            if used == WITNESSES:
                break
        elif not used:
            common &= found
    if used:
        return {i for i, n in enumerate(votes) if n and 2 * n >= used}
    left = any(not furniture for i, (_, _, furniture) in enumerate(own) if i not in common)
    return common if len(others) > 1 and left else set()


def _outside_shared(own: list[Line], others: list[list[Line]], best: int) -> set[int]:
    """Lines outside a marked article that stand on the nearest other page too; they are left out with all else outside it."""
    if not others:
        return set()
    outside = [i for i, (_, level, _) in enumerate(own) if level < best]
    top = _body(others[0])
    return {outside[k] for k in common_subsequence([own[i][0] for i in outside], [text for text, level, _ in others[0] if not (top and level >= top)])}


def _inside_shared(own: list[Line], others: list[list[Line]], best: int) -> set[int]:
    """Short lines inside a marked article that the nearest ``WITNESSES`` pages, no near copies of it or of each other, have in theirs."""
    inside = [i for i, (_, level, furniture) in enumerate(own) if level >= best and not furniture]
    alive = [i for i in inside if len(own[i][0]) <= SHORT_LINE]

    def alike(texts: list[str], other: set[str]) -> bool:
        return sum(len(t) for t in texts if t in other) >= COPY_SHARE * sum(map(len, texts))

    used = [{own[i][0] for i in inside}]
    for other in others:
        top = _body(other)
        theirs = [text for text, level, furniture in other if level >= top and not furniture]
        held = set(theirs)
        if any(alike(theirs, u) or alike(list(u), held) for u in used):
            continue
        used.append(held)
        alive = [i for i in alive if own[i][0] in held]
        if not alive:
            break
        alive = [alive[k] for k in sorted(common_subsequence([own[i][0] for i in alive], theirs))]
        if len(used) > WITNESSES:
            return set(alive)
    return set()


def main_lines(own: list[Line], before: list[list[Line]], after: list[list[Line]]) -> tuple[list[str], int]:
    """The lines that stay, and how many the comparison with other pages of the host deleted."""
    best = _body(own)
    others = _others(own, before, after)
    shared = _outside_shared(own, others, best) | _inside_shared(own, others, best) if best else _unmarked_shared(own, others)
    kept = [text for i, (text, level, furniture) in enumerate(own) if not furniture and level >= best and i not in shared]
    return kept, len(shared)


def _extract(rows: list[dict], own: list[Line], before: list[list[Line]], after: list[list[Line]]) -> Iterator[dict]:
    if not rows:
        return
    kept, shared = main_lines(own, before, after) if rows[0]["host"] else main_lines(own, [], [])
    text = " ".join(kept)
    for row in rows:
        yield {"id": row["id"], "url": row["url"], "text": text, "n_chars": len(text), "n_shared": shared}


def _parsed(html: str | None) -> list[Line]:
    return page_lines(html or "")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (id, url, text, n_chars, n_shared), one for each row of ``pages``.

    Pages are compared with those next to them of their host by path, then id; a page without a
    host with none. A null or empty html gives an empty text. Repeated rows and null ids give
    a row each. An empty table gives no rows; further columns are not read.
    """
    url = F.col(url_col)
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), F.col(html_col).alias("html"), F.lower(host).alias("host"), path.alias("path"), F.xxhash64(url_col, html_col).alias("tie"))
    return with_neighbours(rows, ["host", "path", "id", "tie"], "html", _parsed, _extract, "id long, url string, text string, n_chars long, n_shared long")
