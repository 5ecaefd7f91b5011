"""Main text of web pages by nearest-URL page differencing, held against the page's own landmarks.

Every page is cut into blocks. A block inside menus, headers, footers, sidebars,
notices, adverts, forms or comments (elements, roles, class and id words) is
dropped. What is left of every page is differenced: within each host, pages are
ordered by URL path and each is paired with the neighbour that shares the longer
beginning of the path; the lines of both are aligned by longest common subsequence
and the shared lines deleted. Pages that agree almost wholly are copies, not
templates, and lose no line.

A page that marks its article (``article``, else ``main``, else a content class) is
then checked: lines of the article that its neighbour shares are restored and the
page's own lines outside it dropped. Which mark holds the article is told by the
lines that differencing leaves. Without a mark, what differencing leaves is the text.

Differencing alone can't give the contract's result: menus that differ from page
to page survive it and sentences that two articles share are lost (figures in the
README).

Pages travel as hashes of their lines. Hosts are cut into ranges of about ``SHARD``
pages in order of host and path, and every range sees the last page before it and
the first after it, so the neighbour is the true one and no task holds a host.

Edge cases: null html gives empty text; a null or unparsable url belongs to the
host ''; ties of path go by page_id, then by a hash of the lines; repeated rows are
each other's neighbours and count as copies; other columns are ignored; unclosed
elements end where their container ends, cut-off tags are dropped.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlab.llm._common import staged, table

SHARD = 5000
COPY = 0.9

_token = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(noscript|template|textarea|title|svg|iframe|select|object|canvas|audio|video)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?</\2\s*>"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</?[a-zA-Z][^<>]*>"
    r"|</?[a-zA-Z][\w:-]*(?:\s+[\w:.-]+\s*=[^<>]*|\s*/?[\w:-]*)(?:\Z|(?=<))",  # cut off: a name alone or with attributes, not "a<b then more text"
    re.S | re.I,
)
_attribute = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_space = re.compile(r"\s+")
_part = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
BOILER_TAGS = frozenset("nav aside form button menu dialog footer".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall share sharing social related recommended recommendations sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer foot masthead comment comments reply replies disqus respond widget widgets toolbar skip search form trending teaser toc".split()
)
#: Of these, words that say the same of whatever stands behind them ("related-stories", "sponsored-content").
BOILER_OF = frozenset("ad ads advert adverts advertisement adsbygoogle sponsor sponsored promo cookie newsletter share sharing social related recommended trending sidebar footer nav menu comment comments".split())
CONTENT_WORDS = frozenset("article post entry story content main".split())
#: Behind such a word inside an article, the last word must say that the whole is a device, not content ("share-prices").
DEVICES = frozenset("area bar block box button buttons card cards container content feed icons inline item items link links list message module panel posts row section slot stories strip tools unit units wrap wrapper zone".split())
#: Words that make a paragraph inside an article an advert or notice of the site.
PARAGRAPH_WORDS = frozenset("ad ads advert adverts advertisement adsbygoogle sponsored promo cookie cookies newsletter subscribe".split())
CARD_WORDS = frozenset("card cards teaser teasers preview tile".split())
#: Prefix of tags that would begin such an element but that nothing ends.
UNCLOSED = "unclosed-"
#: Elements whose content is skipped to their end tag.
RAW = ("noscript", "template", "textarea", "title", "svg", "iframe", "select", "object", "canvas", "audio", "video")
#: Elements whose class and id words say what they are for; a heading is judged by its elements only.
CONTAINERS = frozenset("div section aside ul ol dl table td header footer form figure span small label font p iframe details".split())
#: An opening tag ends an element of these kinds that is still open in the same container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table article main section div nav aside header footer form blockquote body".split())


def _boiler_name(name: str, in_article: bool = False, paragraph: bool = False) -> bool:
    """Whether one class or id name says boilerplate: its last word does, or an earlier one that colours the rest.

    "article-sidebar" and "related-story" do, "search-party-story" doesn't. Inside an
    article whole names count: "share-bar" does, "share-prices" and "notice-of-meeting" don't.
    """
    parts = [p.lower() for p in _part.findall(name)]
    if not parts:
        return False
    if in_article and paragraph:
        return any(p in PARAGRAPH_WORDS for p in parts)
    if in_article and len(parts) > 1 and parts[-1] not in BOILER_WORDS | CONTENT_WORDS | DEVICES and not parts[-1].isdigit() and parts[0] != "ad":
        return False
    if parts[-1] in CONTENT_WORDS:
        return any(p in BOILER_OF for p in parts[:-1])
    return any(p in BOILER_WORDS for p in parts)


def _kind(tag: str, raw: str, in_article: bool, wrappers: bool = False) -> tuple[bool, int]:
    """(boilerplate, landmark level) that an element begins."""
    attrs = {m[0].lower(): m[1] or m[2] or m[3] for m in _attribute.findall(raw)} if raw.strip() else {}
    role = attrs.get("role", "").lower()
    named = attrs.get("class", "").split() + attrs.get("id", "").split()
    boiler = tag in BOILER_TAGS or role in BOILER_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    boiler = boiler or tag in CONTAINERS and any(_boiler_name(n, in_article, tag == "p") for n in named)
    words = {p.lower() for p in _part.findall(" ".join(named))}
    if not in_article:  # an article's own header holds its headline
        boiler = boiler or tag == "header" or "header" in words and tag in CONTAINERS
    if tag == "article":
        return boiler or bool(words & CARD_WORDS) and not wrappers, 3
    if tag == "main" or role == "main":
        return boiler, 2
    return boiler, 1 if words & CONTENT_WORDS and tag in ("div", "section", "td") else 0


def blocks(html: str | None) -> tuple[int, list[str]]:
    """(landmark level, lines): the lines that the page's landmarks mark as its article; level 0: no landmark.

    That is the page's only article, else the highest level that has lines, but for a
    lower one (around it) with more text: then the higher one held cards, not the
    article. An article whose class says card is none. Where all articles and mains
    stand inside forms or containers whose class says boilerplate ("no-sidebar"), or
    all are cards, these count.
    """
    found, alone = page_lines(html)
    top = article_level(found, alone)
    return top, [t for level, t in found if level == top]


def page_lines(html: str | None) -> tuple[list[tuple[int, str]], bool]:
    """All lines that are no boilerplate, with the landmark level of each, and whether the page has just one article."""
    source = _without_unclosed(html or "")
    found, alone = _parsed(source, False)
    if max((level for level, _ in found), default=0) < 2 and _landmark.search(source):
        inside = _parsed(source, True)
        if max((level for level, _ in inside[0]), default=0) >= 2:
            return inside
    return found, alone


def article_level(found: Sequence[tuple[int, str]], alone: bool, own: Sequence[bool] | None = None) -> int:
    """The level that holds the article; its text is measured by the lines that are ``own`` to the page, where there are any."""
    top = max((level for level, _ in found), default=0)
    if top == 3 and alone:
        return top
    counted = own if own is not None and any(own) else [True] * len(found)
    held = [sum(len(t) for (level, t), c in zip(found, counted) if c and level == n) for n in range(4)]
    for level in range(top - 1, 0, -1):
        if held[level] > held[top]:
            top = level
    return top


_landmark = re.compile(r"<article\b|<main\b|role\s*=\s*[\"']?main", re.I)


def _without_unclosed(source: str) -> str:
    """Marks raw elements that nothing ends: each would be searched to the end of the page. Their tags only end a block."""
    lower = source.lower() if "<" in source else ""
    for tag in RAW:
        end = max(lower.rfind("</" + tag), 0)
        if lower.find("<" + tag, end) >= 0:
            source = source[:end] + re.sub(rf"<(?={tag}\b)", "<" + UNCLOSED, source[end:], flags=re.I)
            lower = source.lower()
    return source


def _parsed(source: str, wrappers: bool) -> tuple[list[tuple[int, str]], bool]:
    found: list[tuple[int, str]] = []
    stack: list[tuple[str, bool, int]] = [("", False, 0)]
    pieces: list[str] = []
    links: list[tuple[int, int]] = []  # pieces inside links whose class says boilerplate

    def flush() -> None:
        if pieces:
            # Such a link is part of a sentence where its block has other text.
            alone = {k for start, stop in links for k in range(start, min(stop, len(pieces)))}
            if links and not any(p.strip() for k, p in enumerate(pieces) if k not in alone):
                pieces.clear()
            text = _space.sub(" ", "".join(pieces)).strip()
            pieces.clear()
            if text:
                found.append((stack[-1][2], text))
        links.clear()

    open_tags: Counter[str] = Counter()  # of the stack, so that deep pages aren't searched in vain

    def push(tag: str, boiler: bool, level: int) -> None:
        stack.append((tag, boiler, level))
        open_tags[tag] += 1

    def close(names: set[str] | frozenset, within: frozenset = frozenset()) -> None:
        if not any(open_tags[n] for n in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                flush()
                open_tags.subtract(s[0] for s in stack[k:])
                del stack[k:]
                return
            if stack[k][0] in within:
                return

    at = articles = 0
    for m in _token.finditer(source):
        if m.start() > at and not stack[-1][1]:
            text = source[at : m.start()]
            pieces.append(_html.unescape(text) if "&" in text else text)
        at = m.end()
        tag = (m[4] or "").lower()
        if not tag:
            continue
        if m[3]:
            if tag == "p" and not open_tags["p"]:
                flush()
            elif tag in INLINE:
                if tag == "a" and links and links[-1][1] == 10**9:
                    links[-1] = (links[-1][0], len(pieces))
                if open_tags[tag]:
                    _close_inline(stack, open_tags, tag)
            else:
                flush()
                close({tag})
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag.startswith(UNCLOSED):
            flush()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in INLINE:
            if m[5].strip() and tag in ("span", "a", "small", "label", "font"):
                boiler, _ = _kind("span" if tag == "a" else tag, m[5], True)
                if boiler and tag == "a":
                    begun = len(pieces)
                    push(tag, stack[-1][1], stack[-1][2])
                    links.append((begun, 10**9))
                else:
                    push(tag, stack[-1][1] or boiler, stack[-1][2])
            continue
        flush()
        close({"p"}, LISTS)
        if tag in ENDS:
            close(ENDS[tag], LISTS - {"table"} if tag == "tr" else LISTS)
        boiler, level = _kind(tag, m[5], stack[-1][2] >= 2, wrappers)
        inherited = stack[-1][1] and not (wrappers and level >= 2 and stack[-1][2] < 2)
        articles += level == 3 and not (inherited or boiler)
        push(tag, inherited or boiler, max(stack[-1][2], level))
    tail = source[at:]
    if tail and not stack[-1][1]:
        pieces.append(_html.unescape(tail))
    flush()
    return found, articles == 1


def _close_inline(stack: list, open_tags: Counter, tag: str) -> None:
    """Ends an inline element without ending its block; containers opened inside stay."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k][0] == tag:
            if k == len(stack) - 1:
                del stack[k]
                open_tags[tag] -= 1
            return
        if stack[k][0] not in INLINE:
            return


def common_subsequence(a: list, b: list) -> list[int]:
    """Positions in ``a`` of a longest common subsequence.

    Equal ends are taken first. Between them a row of the table is one whole number
    whose bits say where the length grows, so repeated lines cost no more than others.
    """
    low, most = 0, min(len(a), len(b))
    while low < most and a[low] == b[low]:
        low += 1
    high = 0
    while high < most - low and a[-1 - high] == b[-1 - high]:
        high += 1
    inner, other = a[low : len(a) - high], b[low : len(b) - high]
    where: dict = {}
    for j, line in enumerate(other):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(other)) - 1
    rows = [full]  # a zero bit: the length grows there
    for line in inner:
        row, match = rows[-1], where.get(line, 0)
        hit = row & match
        rows.append(((row + hit) | (row - hit)) & full)
    out, j = [], len(other)
    for i in range(len(inner), 0, -1):
        # Back to the last place where the length grew in this row; it grew by line i if the row before has none there.
        grown = ~rows[i] & ((1 << j) - 1)
        if not grown:
            break
        last = grown.bit_length() - 1
        if rows[i - 1] >> last & 1:
            out.append(low + i - 1)
            j = last
    return [*range(low), *out[::-1], *range(len(a) - high, len(a))]


def shared_lines(lines: list, partner: list | None) -> list[int]:
    """Positions of the lines that the partner shares; none for a copy of it."""
    if not partner:
        return []
    shared = common_subsequence(lines, partner)
    return [] if len(shared) >= COPY * max(len(lines), len(partner)) else shared


def checked(found: Sequence[tuple[int, str]], alone: bool, shared: Sequence[int], paired: bool) -> tuple[list[str], str]:
    """(lines, how): what differencing left ('difference'), unless the page's landmarks restore or drop lines of it ('landmark')."""
    gone = set(shared)
    own = [i not in gone for i in range(len(found))]
    level = article_level(found, alone, own)
    inside = [kind == level for kind, _ in found] if level else own
    return [t for (_, t), i in zip(found, inside) if i], "difference" if not level or paired and inside == own else "landmark"


def _shared_start(a: str, b: str | None) -> int:
    if b is None:
        return -1
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, how ('landmark' where landmarks changed what differencing left, else 'difference')."""

    @F.pandas_udf("struct<levels: binary, alone: boolean, packed: binary, lines: array<bigint>>")
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for found, alone in map(page_lines, batch):
                texts = [t for _, t in found]
                hashes = [int.from_bytes(blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) for t in texts]
                rows.append((bytes(level for level, _ in found), alone, zlib.compress("\n".join(texts).encode("utf-8", "replace")), hashes))
            yield pd.DataFrame(rows, columns=["levels", "alone", "packed", "lines"])

    @F.pandas_udf("struct<shared: array<int>, paired: boolean>")
    def differenced(lines: pd.Series, path: pd.Series, before: pd.Series, before_path: pd.Series, after: pd.Series, after_path: pd.Series) -> pd.DataFrame:
        def one(own, p, b, bp, a, ap):
            partner = a if _shared_start(p, ap) > _shared_start(p, bp) else b
            return shared_lines(list(own), None if partner is None else list(partner)), partner is not None

        return pd.DataFrame([one(*row) for row in zip(lines, path, before, before_path, after, after_path)], columns=["shared", "paired"])

    @F.pandas_udf("struct<text: string, how: string>")
    def check(levels: pd.Series, alone: pd.Series, packed: pd.Series, shared: pd.Series, paired: pd.Series) -> pd.DataFrame:
        def one(kinds, single, data, gone, both):
            found = list(zip(kinds, zlib.decompress(data).decode().split("\n")))  # no levels: no lines
            lines, how = checked(found, single, gone, both)
            return "\n".join(lines), how

        return pd.DataFrame([one(*row) for row in zip(levels, alone, packed, shared, paired)], columns=["text", "how"])

    rows = staged(pages.select(F.monotonically_increasing_id().alias("rid"), "page_id", "url", parsed("html").alias("p")).select("rid", "page_id", "url", "p.*"), "pages")

    url = F.coalesce("url", F.lit(""))
    host, path = F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1)), F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)", 1)
    order = ["path", "page_id", "digest", "rid"]  # without the lines: what is ordered is also sampled for the ranges
    ranges = max(1, -(-rows.count() // SHARD))
    bare = rows.select(host.alias("host"), path.alias("path"), "page_id", F.xxhash64("lines").alias("digest"), "rid", "lines")
    bare = staged(bare.repartitionByRange(ranges, "host", *order).withColumn("range", F.spark_partition_id()), "ranges")
    page = F.struct(*order, "lines")
    ends = bare.groupBy("host", "range").agg(F.min(page).alias("first"), F.max(page).alias("last"))
    along = Window.partitionBy("host").orderBy("range")  # a row per range
    ends = ends.select("host", "range", F.array(F.lag("last").over(along), F.lead("first").over(along)).alias("both"))
    edges = ends.select("host", "range", F.explode("both").alias("e")).where("e is not null").select("host", "range", "e.*", F.lit(True).alias("edge"))
    near = Window.partitionBy("host", "range").orderBy(*order)
    bare = bare.select("host", "range", *order, "lines", F.lit(False).alias("edge")).unionByName(edges)
    beside = bare.select("rid", "path", "lines", "edge", *(f(c).over(near).alias(f"{n}_{c}") for n, f in (("before", F.lag), ("after", F.lead)) for c in ("lines", "path")))
    left = beside.where("not edge").select("rid", differenced("lines", "path", "before_lines", "before_path", "after_lines", "after_path").alias("d")).select("rid", "d.*")
    texts = rows.select("rid", "page_id", "url", "levels", "alone", "packed").join(left, "rid").select("page_id", "url", check("levels", "alone", "packed", "shared", "paired").alias("t"))
    return texts.select("page_id", "url", "t.text", F.length("t.text").cast("bigint").alias("n_chars"), "t.how")


def op2_nearest_url_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
