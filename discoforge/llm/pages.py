"""HTML extraction by nearest-URL page differencing: lines that a page shares with its neighbour by path go."""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAIN, PLAIN, EDGE = 2, 1, 0

# Elements by what they mean for the text.
BLOCKS = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed xmp svg math template object".split())
UNSEEN = RAW | {"button", "select", "option", "datalist", "canvas", "audio", "video"}
ASIDE = frozenset("nav footer aside form menu dialog head".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup"
    " sidebar sidenav sidemenu aside menu submenu nav navbar navigation breadcrumb breadcrumbs pagination pager footer bottombar topbar toolbar masthead share sharing social related recommended recommendations"
    " comment comments commentlist disqus replies respond widget login searchform search".split()
)
HEADER_NAMES = frozenset(("header", "masthead"))
CLOSES_P = BLOCKS - {"html", "body", "head"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|[^<]++|<""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")


def _kind(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element by its names is beside the article, is a header, and is the article."""
    roles, names, main = set(), set(), tag in ("article", "main")
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            names.update(x.lower() for x in _NAME.findall(value))
            names.update(re.split(r"[^a-z]+", value.lower()))
        else:
            roles.update(value.lower().split())
    main = main or "main" in roles or "articlebody" in roles
    beside = tag in ASIDE or bool(roles & ASIDE_ROLES) or (tag not in ("html", "body") and bool(names & ASIDE_NAMES))
    return beside, tag == "header" or bool(names & HEADER_NAMES), main and not (names & ASIDE_NAMES)


def blocks(html: str | None) -> list[tuple[str, int]]:
    """The text blocks of a page in order, each with MAIN in the declared article, EDGE beside it by its markup, else PLAIN.

    Scripts, styles, markup and what isn't shown as text give no blocks. An article that opens within an
    element beside it that was never closed ends that element.
    """
    out: list[tuple[str, int]] = []
    if not html:
        return out
    stack: list[tuple[str, int, bool]] = []  # tag, zone within, declared article within
    zone, in_main, held = PLAIN, False, []
    known: dict[tuple[str, str], tuple[bool, bool, bool]] = {}

    def flush():
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((text, zone))
            held.clear()

    def unwind(n: int):
        nonlocal zone, in_main
        del stack[n:]
        zone, in_main = (stack[-1][1], stack[-1][2]) if stack else (PLAIN, False)

    at = 0
    while m := _TOKEN.match(html, at):
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            text = m[0]
            if zone == EDGE and next((z != EDGE for t, z, _ in reversed(stack) if t in BLOCKS), False):
                continue  # an inline element beside the article, within a block of it
            if text[0] != "<" or text == "<":
                held.append(unescape(text) if "&" in text else text)
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag in BLOCKS:
                flush()
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == tag:
                    unwind(n)
                    break
            continue
        attributes = m[3] or m[6] or ""
        if tag in BLOCKS:
            flush()
        if tag in UNSEEN and not attributes.endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            if end or tag in RAW:
                at = end.end() if end else len(html)
            continue
        if tag == "br":
            held.append(" ")
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in CLOSES_P:
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == "p":
                    unwind(n)
                    break
                if stack[n][0] in BLOCKS:
                    break
        if (tag, attributes) not in known:
            known[tag, attributes] = _kind(tag, attributes)
        beside, header, main = known[tag, attributes]
        if tag == "body" or (main and zone == EDGE):
            unwind(next((n for n, s in enumerate(stack) if s[1] == EDGE), len(stack)))
        if main and zone != EDGE:
            zone, in_main = MAIN, True
        if beside or (header and not in_main):
            zone = EDGE
        stack.append((tag, zone, in_main))
    flush()
    return out


def shared(a: list, b: list) -> np.ndarray:
    """Whether each item of a is in the longest common subsequence of a and b.

    Bit vectors hold a row of lengths each; beyond 2^28 bits the halves of a are aligned with the best split of b.
    """
    out = np.zeros(len(a), bool)
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        out[n] = True
        n += 1
    a_end, b_end = len(a), len(b)
    while a_end > n and b_end > n and a[a_end - 1] == b[b_end - 1]:
        a_end, b_end = a_end - 1, b_end - 1
        out[a_end] = True
    x, y = a[n:a_end], b[n:b_end]
    if not x or not y:
        return out
    if len(x) * len(y) > 1 << 28 and len(x) > 1:
        half = len(x) // 2
        ahead, behind = _row_lengths(x[:half], y), _row_lengths(x[half:][::-1], y[::-1])[::-1]
        cut = int((ahead + behind).argmax())
        out[n : n + half] = shared(x[:half], y[:cut])
        out[n + half : a_end] = shared(x[half:], y[cut:])
        return out
    rows = list(_rows(x, y))
    i, j = len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1]:
            out[n + i - 1] = True
            i, j = i - 1, j - 1
        elif rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return out


def _rows(x: list, y: list):
    """After each item of x: bits that are 0 where the common length grows along y."""
    every, places = (1 << len(y)) - 1, {}
    for j, item in enumerate(y):
        places[item] = places.get(item, 0) | 1 << j
    v = every
    for item in x:
        u = v & places.get(item, 0)
        v = ((v + u) | (v - u)) & every
        yield v


def _row_lengths(x: list, y: list) -> np.ndarray:
    """Common length of x and each prefix of y, the empty one first."""
    for v in _rows(x, y):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


#: If a page shares so much of the text that might go with its neighbour, the two may be copies, and a second page beside it is asked too.
COPY_SHARE = 0.9
#: A declared article is the body if it holds so much of what the page has for itself.
BODY_SHARE = 0.5
#: A range of pages in order of their paths holds about so many characters; more where there would be more ranges than
#: MOST_RANGES, of each of which the driver holds four keys.
RANGE_CHARS, MOST_RANGES = 16_000_000, 10_000


def article(page: list[tuple[str, int]], neighbour: list[tuple[str, int]] | None, other: list[tuple[str, int]] | None = None, *more: list[tuple[str, int]]) -> str:
    """The page's text without the lines it shares with its neighbour and the lines beside the article.

    The lines of both pages are aligned; what is not shared is the page's own text, and lines beside the article by
    their markup are no part of it. A page that shares nearly all of its text with its neighbour is a copy or a
    short article on a large template: there only lines that a second page, if any, shares too count as shared, and
    all stay if none would be left. If a declared article holds most of the own text, it is the body, and own lines
    around it go. Of the body's shared lines those go that the bodies of all pages beside it, two or more, start or end
    with as well; the others come back, since articles quote each other. A body that is mostly shared is a copy's and
    stays whole. An article that holds less of the own text is a card or a teaser, and its markup decides nothing.
    """
    size = np.array([len(t) for t, _ in page], np.int64)
    plain, main = (np.array([z == zone for _, z in page], bool) for zone in (PLAIN, MAIN))
    open_ = plain | main
    same = shared([t for t, _ in page], [t for t, _ in neighbour]) if neighbour else np.zeros(len(page), bool)
    if other and size[same & open_].sum() >= COPY_SHARE * size[open_].sum():
        same &= shared([t for t, _ in page], [t for t, _ in other])
    keep = open_ & ~same
    if main.any() and size[keep & main].sum() >= BODY_SHARE * size[keep].sum():
        keep = _body(page, size, main, same, [neighbour, *[p for p in (other, *more) if p is not None]])
    elif not keep.any():
        keep = open_ if open_.any() else np.ones(len(page), bool)  # a copy; or names misled: all of it is better than nothing
    return "\n".join(t for (t, _), k in zip(page, keep) if k)


def _body(page: list, size: np.ndarray, main: np.ndarray, same: np.ndarray, beside: list) -> np.ndarray:
    """The lines of a declared article without those that the articles of all pages beside it start or end with too."""
    if len(beside) < 2 or not (main & ~same).any() or size[main & same].sum() >= BODY_SHARE * size[main].sum():
        return main
    at = np.flatnonzero(main)
    mine = [page[n][0] for n in at]
    theirs = [[t for t, z in other if z == MAIN] for other in beside]
    lead = min(_alike(mine, x) for x in theirs)
    tail = min(_alike(mine[lead:][::-1], x[lead:][::-1]) for x in theirs)
    keep = main.copy()
    keep[at[:lead]] = keep[at[len(at) - tail :]] = False
    return keep if keep.any() else main


def _alike(a: list, b: list) -> int:
    """Items that a and b start with alike."""
    return next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def nearness(a: str, b: str) -> int:
    """Path segments that two paths start with alike."""
    n = 0
    for x, y in zip(a.split("/"), b.split("/")):
        if x != y:
            break
        n += 1
    return n


def _difference(batches):
    """Rows come by range, in order of host and path; each page is held until the next two of its range have come. Rows that are not the range's own only stand beside others."""
    near, at = [], 0  # up to two pages before the one at, itself, those after

    def settle():
        nonlocal at
        row, mine = near[at]
        beside = lambda n: sorted((near[i] for i in (at - n, at + n) if 0 <= i < len(near) and near[i][0][4] == row[4]), key=lambda s: -nearness(s[0][5], row[5]))
        sides = [*beside(1), *beside(2)]
        text = article(mine, *[s[1] for s in sides] or [None]) if row[1] else None
        if at == 2:
            near.pop(0)
        else:
            at += 1
        return [] if text is None else [(row[2], row[3], text, len(text))]

    def rest():
        nonlocal at
        out = [r for _ in range(len(near) - at) for r in settle()]
        near.clear()
        at = 0
        return out

    for batch in batches:
        out = []
        for row in batch[["part", "own", "page_id", "url", "host", "path", "html"]].itertuples(index=False, name=None):
            if near and near[0][0][0] != row[0]:
                out += rest()
            near.append((row[:6], blocks(row[6])))
            if len(near) > at + 2:
                out += settle()
        yield _frame(out)
    yield _frame(rest())


def _frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "url", "text", "n_chars"])
    return out.astype({"n_chars": "int64"})


_ORDER = ["host", "path", "link", "number", "seal"]


def _ends(batches):
    """The first two keys of a task's rows, which come in order, and the last two."""
    first, last = [], []
    for batch in batches:
        for row in batch[_ORDER].itertuples(index=False, name=None):
            if len(first) < 2:
                first.append(row)
            last = [*last[-1:], row]
    if first:
        part = TaskContext.get().partitionId()
        yield pd.DataFrame([(part, side, *key) for side, keys in (("first", first), ("last", last)) for key in keys], columns=["part", "side", *_ORDER])


class Ranges:
    """Ranges of the order of pages. A page is of one range, and stands beside the pages of the next if it is one of the two before or after them."""

    def __init__(self, ends: list[tuple[str, list[tuple], list[tuple]]]):
        self.starts = [first[0] for _, first, _ in ends]
        before, after = [], []  # from where on, and up to where, pages stand beside a range
        held: list[tuple] = []
        for _, _, last in ends:
            before.append(held[-2:][0] if held else None)
            held += last
        held = []
        for _, first, _ in reversed(ends):
            after.append(held[:2][-1] if held else None)
            held = first + held
        self.before, self.after = before, after[::-1]

    def of(self, key: tuple) -> list[int]:
        """The range of a page, and then those beside which it stands."""
        at = max(0, bisect_right(self.starts, key) - 1)
        out = [at]
        n = at + 1
        while n < len(self.starts) and key >= self.before[n]:
            out.append(n)
            n += 1
        n = at - 1
        while n >= 0 and key <= self.after[n]:
            out.append(n)
            n -= 1
        return out


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages: the article, its blocks joined by line breaks.

    Pages are put in order by host, path and the rest of the url, so that a page's neighbours by path stand next to
    it, and cut into ranges, so that a host of any size spreads over tasks; the pages at the ends of a range stand
    beside the next range too, so the cuts don't matter to the texts. Of the two neighbours the one with more of the
    path in common is compared, and where the two share nearly all, the other one too; what a declared article starts and
    ends with is held against all pages up to two places away. The first page of a host has the two after it, the last one
    the two before. Lines are aligned by longest common subsequence.

    Null and empty html give an empty text. A null url is a host and path of its own. Repeated rows and urls
    each give their row; copies of a page keep the text that not all pages beside them have. Other columns are ignored, an empty table gives an
    empty result.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:www\.)?([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    rows = pages.select("page_id", "url", "html", host.alias("host"), path.alias("path"), url.alias("link"), number.alias("number"), F.xxhash64("html").alias("seal"))
    parts = min(MOST_RANGES, max(1, (rows.agg(F.sum(F.length("html"))).first()[0] or 0) // RANGE_CHARS))
    kinds = ", ".join(f"{c} {t}" for c, t in rows.select(_ORDER).dtypes)
    laid = rows.select(_ORDER).repartitionByRange(parts, *_ORDER).sortWithinPartitions(*_ORDER)
    found: dict[int, tuple[int, list, list]] = {}
    for r in laid.mapInPandas(_ends, f"part int, side string, {kinds}").collect():  # four keys a range at most
        ends = found.setdefault(r["part"], (r["part"], [], []))
        ends[1 if r["side"] == "first" else 2].append(tuple(r[c] for c in _ORDER))
    ranges = Ranges([(n, sorted(a), sorted(b)) for n, a, b in sorted(found.values())])

    @F.pandas_udf("array<int>")
    def places(host: pd.Series, path: pd.Series, link: pd.Series, number: pd.Series, seal: pd.Series) -> pd.Series:
        return pd.Series([ranges.of(key) for key in zip(host, path, link, number, seal)], dtype=object)

    placed = rows.select("*", F.posexplode(places(*_ORDER)).alias("beside", "part")).withColumn("own", F.col("beside") == 0)
    placed = placed.repartition(max(1, len(found)), "part").sortWithinPartitions("part", *_ORDER)
    return placed.mapInPandas(_difference, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
