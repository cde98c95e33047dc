"""Main text of web pages by consensus host paths.

Each page is cut into text blocks, each below a path of containers.  Every path is
generalised (tag and class, numbers left out) and scored by the text it holds less its
links; pages vote for their paths, and the votes are added up per host in Spark.
Every page is then extracted again with the winning paths of its host, so a page whose own scores mislead
follows the others, and with all its other paths but those whose text the host repeats from page to page.

Elements such as menus, footers and forms are never part of the text.  A class, id or role that speaks of a sidebar, a
comment or the like counts as a vote against its path, by a factor of ten; what stands in such a container
is left out unless the host's pages make it a winner all the same.  Inside a winner, or any other article, it is left out.
Words that all blocks of a page stand below (``<body class="has-sidebar">``) say nothing about any of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from shelfledger.llm.common import columns, written

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup.
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp"))
#: Elements that never hold article text.
DROPPED = frozenset(
    "head script style noscript template textarea title iframe xmp nav footer aside form button select "
    "option svg canvas object audio video dialog menu label fieldset datalist".split()
)
#: Elements inside a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr input".split()
)
#: Elements that stand for the blocks, not for a place to vote on.
LEAF = frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd td th tr thead tbody tfoot pre blockquote figcaption ul ol dl table figure "
    "address caption hgroup".split()
)
#: Words in a class, id or role that mark other things than the article.
BAD_WORDS = re.compile(
    r"(?:^|[^a-z])(?:ad|ads|adv|advert\w*|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|breadcrumb\w*|header|masthead|"
    r"topbar|footer|foot|sidebar\w*|side|aside|widget\w*|related\w*|recommend\w*|share|sharing|social|"
    r"comment\w*|disqus|reply|replies|respond|discussion|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|"
    r"newsletter|subscri\w*|signup|login|form|search|toolbar|pagination|pager|tags|hidden|complementary|"
    r"contentinfo|navigation|dialog|skip)(?![a-z])"
)
GOOD_WORDS = re.compile(r"[.-](?:article|content|entry|post|story|text|body|main)(?![a-z])")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true")

#: Share of the host's leading path that other winners need.
WIN_SHARE = 0.3
#: Share of a path's pages whose text there stands on another page too, above which it is boilerplate.
REPEATED_SHARE = 0.5
#: Factor on the votes for a path for each class word against it.
AGAINST = 0.1
#: Containers nested deeper count to the one at this depth.
MAX_DEPTH = 200
#: Keys over which the pages of one host are spread.
SALTS = 32

_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|"
    r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>",  # possessive: no text is read twice
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NUMBER = re.compile(r"\d+")

VOTE = StructType(
    [
        StructField("path", StringType()), StructField("score", DoubleType()),
        StructField("text", LongType()), StructField("page", LongType()), StructField("leads", BooleanType()),
    ]
)


def _generalised(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """Tag with its class (numbers as #), whether its tag rules it out, and whether its names speak against it."""
    if not attributes:
        return tag, tag in DROPPED, False
    known = _NAMES.get((tag, attributes))
    if known is None:
        if len(_NAMES) >= 20_000:
            _NAMES.clear()
        known = _NAMES[tag, attributes] = _read_names(tag, attributes)
    return known


#: Names of elements read before, a bounded memory of each task: pages of a host repeat them.
_NAMES: dict[tuple[str, str], tuple[str, bool, bool]] = {}


def _read_names(tag: str, attributes: str) -> tuple[str, bool, bool]:
    found = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), next((v for v in values if v), ""))
    names = " ".join(found.values()).lower()
    out = tag in DROPPED or bool(HIDDEN.search(attributes))
    classes = sorted(_NUMBER.sub("#", found.get("class", "").lower()).split())
    return ".".join([tag, *classes]), out, bool(names and BAD_WORDS.search(names))


class _Open(NamedTuple):
    """An open element: its container path, whether it is ruled out, and where names speak against it."""

    tag: str
    path: str = ""
    out: bool = False
    against: tuple[int, ...] = ()  # depths of containers
    inner: bool = False  # an element that is no container of its own

    def below(self, tag: str, attributes: str, in_article: bool) -> _Open:
        name, out, bad = _generalised(tag, attributes)
        out = self.out or out or (tag == "header" and not in_article)
        depth = self.path.count("/") + 1
        if tag in LEAF or tag in INLINE or depth > MAX_DEPTH:
            return _Open(tag, self.path, out, self.against, self.inner or bad)
        against = (*self.against, depth) if bad else self.against
        return _Open(tag, f"{self.path}/{name}", out, against, self.inner)


#: Container path, text, letters inside links, and the depths of the containers whose names speak
#: against it; None in their place rules the block out.
Block = tuple[str, str, int, tuple[int, ...] | None]


def blocks(html: str | None) -> list[Block]:
    """The text blocks of a page, in page order.

    A block is ruled out by an element around it or by a class inside its article.  Words that all blocks of the
    page stand below are not counted against any.  Character references are decoded, white space becomes one space, blocks without text are
    left out.  An end tag closes the nearest open element of its name; a new paragraph, item or
    heading closes an open paragraph.
    """
    if not html:
        return []
    found: list[Block] = []
    stack: list[_Open] = []
    count: dict[str, int] = {}  # open elements by tag
    roots: dict[str, int] = {}  # depth of the article of a path
    parts: list[str] = []
    linked, in_link = 0, 0
    nothing = _Open("")

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join(unescape("".join(parts)).split())
        if text:
            top = stack[-1] if stack else nothing
            if top.path not in roots:
                roots[top.path] = root_of(top.path).count("/")
            depth = roots[top.path]
            inside = top.inner or any(k > depth for k in top.against)
            found.append((top.path, text, min(linked, len(text)), None if top.out or inside else top.against))
        parts, linked = [], 0

    def open_(tag: str, attributes: str) -> None:
        above = stack[-1] if stack else nothing
        stack.append(above.below(tag, attributes, bool(count.get("article") or count.get("main"))))
        count[tag] = count.get(tag, 0) + 1

    def close(k: int) -> None:
        for element in stack[k:]:
            count[element.tag] -= 1
        del stack[k:]

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    at = 0
    while True:
        match = _TAG.search(html, at)
        if match is None:
            break
        add(html[at : match.start()])
        at = match.end()
        closing, tag, attributes = match[1], match[2], match[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in RAW and not closing:
            if tag in DROPPED:
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
        if tag in INLINE:
            if tag in ("br", "wbr", "img", "input"):
                parts.append(" " if tag != "wbr" else "")
            elif not closing and attributes and any(_generalised(tag, attributes)[1:]):
                flush()
                open_(tag, attributes)
            elif closing and stack and stack[-1].tag == tag:
                flush()
                close(len(stack) - 1)
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1 if count.get(tag) else -1, -1, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag not in LEAF and stack[k].tag not in INLINE and tag in LEAF:
                    break  # a stray end tag does not close containers
            in_link = 0
        elif tag not in VOID:
            while stack and (
                stack[-1].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6")
                or (stack[-1].tag in INLINE)
                or (tag == "li" and stack[-1].tag == "li")
                or (tag in ("dt", "dd") and stack[-1].tag in ("dt", "dd"))
            ):
                close(len(stack) - 1)
            if not attributes.rstrip().endswith("/"):
                open_(tag, attributes)
            elif tag in DROPPED:
                continue
    add(html[at:])
    flush()
    counted = [(path, against) for path, _, _, against in found if against is not None]
    common: set[int] = set()
    if counted:
        parts_of_first = counted[0][0].split("/")
        for depth in counted[0][1]:
            above = "/".join(parts_of_first[: depth + 1])
            if all(path == above or path.startswith(above + "/") for path, _ in counted):
                common.add(depth)
    return [
        (path, text, n, against and tuple(k for k in against if k not in common))
        for path, text, n, against in found
    ]


def root_of(path: str) -> str:
    """The container that a path belongs to: its article, else its main part, else a container
    whose class says content, else the path itself.  Headings beside the body stay with it."""
    parts = path.split("/")
    for tags in (("article",), ("main",)):
        for k in range(len(parts) - 1, 0, -1):
            if parts[k].split(".")[0] in tags:
                return "/".join(parts[: k + 1])
    for k in range(1, len(parts)):
        if GOOD_WORDS.search(parts[k]):
            return "/".join(parts[: k + 1])
    return path


def path_scores(found: list[Block]) -> dict[str, float]:
    """Score of each container of a page: letters of text outside links, in long blocks twice,
    a tenth of it for each word against the container."""
    scores: dict[str, float] = {}
    for path, text, linked, against in found:
        if against is not None:
            free = len(text) - 2 * linked
            worth = (free if len(text) < 80 else 2 * free) * AGAINST ** len(against)
            root = root_of(path)
            scores[root] = scores.get(root, 0.0) + worth
    return {p: s for p, s in scores.items() if s > 0}


def path_texts(found: list[Block]) -> dict[str, int]:
    """Hash of the text that each container of a page holds, over the blocks that count."""
    texts: dict[str, xxhash.xxh64] = {}
    for path, text, _, against in found:
        if against is not None:
            texts.setdefault(root_of(path), xxhash.xxh64(seed=42)).update(f"{text}\n".encode("utf-8", "replace"))
    return {p: _signed(h.intdigest()) for p, h in texts.items()}


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def candidate_paths(found: list[Block]) -> list[str]:
    """Containers of a page's text and all that hold them, in alphabetical order."""
    out = set()
    for path, _, _, against in found:
        if against is not None:
            parts = path.split("/")
            out.update("/".join(parts[: k + 1]) for k in range(len(parts)))
    return sorted(out)


def main_text(html: str | None, winners: list[str] | None, repeated: list[str] | None = None) -> str:
    """The text below the winning paths, without one on this page below the page's own best path, and below all
    other paths with a score that are not ``repeated`` boilerplate and have no word against them."""
    found = blocks(html)
    own = path_scores(found)
    chosen = [w for w in winners or [] if any(_under(w, *block) for block in found)]
    if not chosen:
        chosen = [max(own, key=lambda p: (own[p], p))] if own else []
    again = set(repeated or [])
    others = {p for p in own if p not in again}
    kept = [
        text
        for path, text, n, against in found
        if (against == () and root_of(path) in others)
        or any(_under(w, path, text, n, against) for w in chosen)
    ]
    return "\n".join(kept)


def _under(winner: str, path: str, text: str, linked: int, against: tuple[int, ...] | None) -> bool:
    """Whether a block stands below a winning path, with no word against it from there on."""
    if against is None or not (path == winner or path.startswith(winner + "/")):
        return False
    depth = winner.count("/")
    return all(k <= depth for k in against)


def host_of(url: Column) -> Column:
    """Host in lower case without port; empty for null and for addresses without one."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(host, F.lit(""))


def votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, pages, score, repeated, varied): the votes of all pages, added up per host.

    Every path with a score is voted for.  ``repeated`` counts the votes whose text stands below
    the same path of another page and is not the best of each of these pages, as an article's copies
    are.  ``varied``: the pages of the path are not all copies of one page.
    """

    @F.pandas_udf(ArrayType(VOTE))
    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = []
            for text in texts:
                found = blocks(text)
                own, hashes = path_scores(found), path_texts(found)
                total = sum(own.values())
                page = _signed(xxhash.xxh64_intdigest(repr(sorted(hashes.items())), 42))
                top = max(own.values(), default=0.0)
                rows.append([(p, s / total, hashes[p], page, s == top) for p, s in sorted(own.items())])
            yield pd.Series(rows)

    rows = columns(pages, url, html).select(host_of(F.col(url)).alias("host"), F.explode(vote(F.col(html))).alias("v"))
    # Equal texts meet first, so that a host's pages are spread over as many keys as it has texts.
    texts = rows.groupBy("host", "v.path", "v.text").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("v.score").alias("score"),
        F.min("v.page").alias("first"), F.max("v.page").alias("last"), F.every("v.leads").alias("leads"),
    )
    again = (F.col("pages") > 1) & ~F.col("leads")
    return texts.groupBy("host", "path").agg(
        F.sum("pages").alias("pages"), F.sum("score").alias("score"),
        F.sum(F.when(again, F.col("pages")).otherwise(0)).alias("repeated"),
        (F.min("first") != F.max("last")).alias("varied"),
    )


def winning_paths(voted: DataFrame) -> DataFrame:
    """(host, path, won, boilerplate) of every path voted for.

    ``won``: it has at least WIN_SHARE of the score of the host's leading path.
    """
    ranked = voted.groupBy("host").agg(F.max("score").alias("top"))
    return voted.join(ranked, "host").select(
        "host", "path", (F.col("score") >= WIN_SHARE * F.col("top")).alias("won"),
        (F.col("varied") & (F.col("repeated") > REPEATED_SHARE * F.col("pages"))).alias("boilerplate"),
    )


def extract(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """(page_id, url, text, n_chars, host, n_winners) of every page.

    Null and empty html give empty text.  Pages without a host vote as one host.  Repeated
    pages are extracted each.  Ties between paths go to the first in alphabetical order.  An empty table gives no
    rows; other columns, whatever their names, are left out.  Pages of any length are read whole, in time
    linear in their length; markup that never ends is text.
    """
    judged = written(winning_paths(written(votes(pages, url, html))))

    @F.pandas_udf(ArrayType(StringType()))
    def candidates(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([candidate_paths(blocks(t)) for t in texts], dtype=object)

    @F.pandas_udf(StringType())
    def again(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for texts, won, repeated in batches:
            yield pd.Series(
                [
                    main_text(t, None if w is None else list(w), None if r is None else list(r))
                    for t, w, r in zip(texts, won, repeated, strict=True)
                ],
                dtype=object,
            )

    rows = columns(pages, page_id, url, html).select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"),
        host_of(F.col(url)).alias("host"),
    )
    # Pages with the same containers share one layout; its lists hold paths of its own page only, so
    # they stay short however many paths a host has.
    rows = rows.withColumn("paths", candidates.asNondeterministic()(F.col("html")))
    layouts = written(rows.select("host", "paths").distinct())
    marked = layouts.select("host", "paths", F.explode("paths").alias("path")).join(judged, ["host", "path"])
    marked = marked.groupBy("host", "paths").agg(
        F.sort_array(F.collect_list(F.when(F.col("won"), F.col("path")))).alias("winners"),
        F.sort_array(F.collect_list(F.when(F.col("boilerplate"), F.col("path")))).alias("repeated"),
    )
    n_winners = judged.groupBy("host").agg(F.count_if("won").cast("int").alias("n_winners"))
    # A host may hold a third of all pages: its pages are dealt to SALTS keys, each row of its layouts to all.
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    marked = layouts.join(marked, ["host", "paths"], "left").join(n_winners, "host", "left")
    marked = marked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.join(marked, ["host", "paths", "salt"], "left")
    rows = rows.withColumn("text", again.asNondeterministic()(F.col("html"), F.col("winners"), F.col("repeated")))
    return rows.select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "host",
        F.coalesce("n_winners", F.lit(0)).alias("n_winners"),
    )
