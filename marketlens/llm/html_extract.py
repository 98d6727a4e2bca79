"""Main text of web pages by consensus paths per host.

A page is cut into blocks of text. Every container that holds blocks is
scored by the text outside links below it, halved for each level between; a
container is named by its generalised path (tags and classes from the root,
digits removed), so that sections of one kind count together. In Spark the
pages of a host vote for paths with their shares of score; the path with most
votes is the host's, and every page is extracted again with it. A page that
lacks the path, or has no text there, is extracted with its own best path.

As nested text outweighs the text beside it, the winner may be a part of the
article (its sections, a list, a table). It is lifted to the nearest article or
main element around it or, without one, to the container above as long as what
that adds is content in the main: paragraphs, headings, lists, quotes, cells.

Votes are sums, pre-aggregated before the shuffle, so a host may hold any
share of the pages. The winners are a written table of one row per host; the
pages join it, broadcast only if Spark finds it small.

Left out: menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, comments. Tags, roles and hidden elements decide at once; words of a
class or id only in part:

* a container whose class, or id, consists of such words (and ones like "box" or
  "list") goes, wherever it is;
* outside an article a container with such a word in a class goes, unless it
  holds the main element or an article;
* any other mention (inside an article, or in an id as made from a heading's
  text) drops a container only if half of its text is links; headings and
  paragraphs of an article only go as adverts or by their links;
* a form goes unless it holds an article or over half of the page's content.

A heading inside an article's header is kept.

Defined cases: null or empty html gives empty text; a url without a host
votes under the empty host; broken markup is read as browsers read it in the
main (unclosed paragraphs and list items end where the next begins, unknown
end tags are ignored, elements nested deeper than ``MAX_DEPTH`` become siblings);
reading is linear in the page, however long or broken; an empty table gives an
empty one; repeated rows are extracted each; ties between paths go
to the smaller one by code point; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.session import write_table

# HTML element kinds, and words that mark boilerplate.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = ("script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "object", "canvas", "math")
DROPPED_TAGS = frozenset("head nav aside footer menu dialog button select option fieldset search title".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification "
    "pager pagination paywall popup promo promoted promotion promotions related replies respond share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
ADVERT_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising promo promoted sponsor sponsored".split())
#: Words that say nothing of what a container holds, in names such as "ad-box" or "related-posts".
PLAIN_WORDS = frozenset(
    "area articles bar block bottom box button buttons container content group inner item items left link links list message outer panel "
    "posts right section slot stories top unit wrap wrapper".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose own text is content; text anywhere below the second kind is.
CONTENT_TAGS = HEADINGS | frozenset("p li dt dd td th blockquote pre figcaption caption summary".split())
CONTENT_WITHIN = frozenset("li dd blockquote pre figcaption".split())
#: Share of content in what a container adds, from which the winner is lifted to it.
CONTENT_SHARE = 0.75

#: Elements nested deeper become siblings, as in browsers.
MAX_DEPTH = 512

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s>/])", re.IGNORECASE) for t in RAW_TAGS}
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z]+")
#: An open element that a start tag of the key's kind ends first.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDS = frozenset("ul ol menu dl table tbody thead tfoot tr select".split())


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether an end tag, attributes) of each tag; comments and the like have no name.

    A raw element (script, style ...) is one tag up to its end. One pass: the
    search for a tag's end respects quotes until it once finds none.
    """
    at, last, quoted = 0, page.rfind(">"), True
    while True:
        i = page.find("<", at)
        if i < 0 or i > last and not page.startswith("<!--", i):
            return
        if page.startswith("<!--", i) or page.startswith("<![CDATA[", i):
            mark = "-->" if page[i + 2] == "-" else "]]>"
            j = page.find(mark, i + 4)
            at = len(page) if j < 0 else j + 3
            yield i, at, "", False, ""
            continue
        if page.startswith(("<!", "<?"), i):
            at = page.find(">", i) + 1
            yield i, at, "", False, ""
            continue
        end = page.startswith("</", i)
        m = _NAME.match(page, i + 1 + end)
        if not m:
            at = i + 1
            continue
        j = m.end()
        while quoted:
            stop = _STOP.search(page, j)
            if stop and stop[0] == ">":
                j = stop.start()
                break
            j = page.find(stop[0], stop.end()) + 1 if stop else 0
            if not j:  # no end outside quotes in the rest of the page
                quoted, j = False, m.end()
        if not quoted:
            j = page.find(">", j)
        tag, attrs, at = m[0].lower(), page[m.end() : j], j + 1
        if tag in _RAW_END and not end and not (tag in ("svg", "math") and attrs.endswith("/")):
            close = _RAW_END[tag].search(page, at)
            at = (page.find(">", close.end()) + 1 or len(page)) if close else len(page)
        yield i, at, tag, end, attrs


def _element(tag: str, attrs: str, in_article: bool) -> tuple[str, bool, str]:
    """(generalised name, dropped, doubt) of a start tag.

    Doubts are settled when the page is read: "links" (goes if half of its text
    is links), "form", "class" (stays if it holds the article).
    """
    dropped, doubt = tag in DROPPED_TAGS, "form" if tag == "form" else ""
    if not attrs.strip():
        return tag, dropped, doubt
    found = {}
    for name, value in _ATTR.findall(attrs):
        found.setdefault(name.lower(), html_lib.unescape(value.strip("\"'")))
    classes, role = found.get("class", "").lower(), found.get("role", "").lower()
    dropped = (
        dropped
        or role in DROPPED_ROLES
        or "hidden" in found
        or found.get("aria-hidden", "").lower() == "true"
        or "display:none" in found.get("style", "").replace(" ", "").lower()
    )
    doubt = doubt or ("form" if role == "form" else "")
    kinds = sorted({k for k in (re.sub(r"[\d>]+", "", c).strip("-_") for c in classes.split()) if k})
    if not dropped and tag not in ("body", "html", "main", "article"):
        tokens = [{w for w in _SPLIT.split(c) if w} for c in classes.split()]
        of_id = {w for w in _SPLIT.split(found.get("id", "").lower()) if w}
        named = any(t & DROPPED_WORDS for t in tokens)

        def wholly(words: set[str], marks: frozenset[str] = DROPPED_WORDS) -> bool:
            return bool(words & marks) and words <= marks | PLAIN_WORDS

        if tag == "p" or tag in HEADINGS:
            dropped = any(wholly(t, ADVERT_WORDS if in_article else DROPPED_WORDS) for t in tokens)
            doubt = doubt or ("links" if named else "")
        elif any(wholly(t) for t in tokens) or wholly(of_id):
            dropped = True
        elif named and not in_article:
            doubt = doubt or "class"
        elif named or of_id & DROPPED_WORDS:
            doubt = doubt or "links"
    return ".".join([tag, *kinds]), dropped, doubt


Block = tuple[tuple[str, ...], str, int, bool]


class _Open(NamedTuple):
    """An open element, with what holds for all text in it."""

    tag: str
    path: tuple[str, ...]  # containers down to it; paragraphs and headings are none
    dropped: bool
    doubts: tuple[int, ...]
    within: bool  # in an element whose text is content
    article: bool
    header: bool


_ROOT = _Open("", (), False, (), False, False, False)


def blocks(page: str | None) -> list[Block]:
    """(path of the containers, text, characters in links, whether content) of each block kept, in page order."""
    out: list[tuple[Block, tuple[int, ...]]] = []
    stack: list[_Open] = []
    count: dict[str, int] = defaultdict(int)  # open elements by tag
    doubts: list[list] = []  # kind, holds an article, characters, linked, characters of content
    paths: dict[tuple[int, str], tuple[str, ...]] = {}  # by the path above and the name: one object a path, however deep
    text: list[str] = []
    linked, in_link, at = 0, 0, 0
    page = page or ""

    def top() -> _Open:
        return stack[-1] if stack else _ROOT

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            here = top()
            if joined and not here.dropped:
                in_links = min(linked, len(joined))
                content = (here.tag in CONTENT_TAGS or here.within) and 2 * in_links <= len(joined)
                out.append(((here.path, joined, in_links, content), here.doubts))
                for d in here.doubts:
                    doubts[d][2] += len(joined)
                    doubts[d][3] += in_links
                    doubts[d][4] += len(joined) * content
            text.clear()
        linked = 0

    def put(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html_lib.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if in_link:
                linked += len(piece)

    def close(to: int) -> None:
        flush()
        for e in stack[to:]:
            count[e.tag] -= 1
        del stack[to:]

    for start, end, tag, is_end, attrs in _tags(page):
        put(page[at:start])
        at = end
        if tag == "a":
            in_link = 0 if is_end else 1
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag == "title":
            flush()
            continue
        if tag not in BLOCK_TAGS:
            continue
        in_link = 0
        if is_end:
            if count[tag]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag))
            else:
                flush()
            continue
        flush()
        if top().tag == "p" or top().tag in HEADINGS and tag in HEADINGS:
            close(len(stack) - 1)
        if tag in _ENDS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in _ENDS[tag]:
                    close(i)
                    if tag != "tr" or top().tag != "tr":
                        break
                elif stack[i].tag in _HOLDS or stack[i].tag in ("div", "article", "section", "main", "body"):
                    break
        if tag in ("html", "body") and count[tag] or tag in VOID_TAGS:
            continue
        if tag == "body" and count["head"]:
            close(next(i for i, e in enumerate(stack) if e.tag == "head"))
        if len(stack) >= MAX_DEPTH:
            close(MAX_DEPTH - 1)
        above = top()
        name, dropped, doubt = _element(tag, attrs, above.article)
        if tag in ("main", "article"):
            for d in above.doubts:
                doubts[d][1] = True
        if tag == "header":  # dropped, but for headings of an article
            dropped = dropped or not above.article
        elif above.header and tag not in HEADINGS and tag not in ("div", "hgroup"):
            dropped = True
        inner = above.doubts
        if doubt and not above.dropped:
            inner = (*inner, len(doubts))
            doubts.append([doubt, False, 0, 0, 0])
        path = above.path
        if tag != "p" and tag not in HEADINGS:
            key = id(above.path), name
            path = paths.get(key) or paths.setdefault(key, (*above.path, name))
        stack.append(_Open(tag, path, above.dropped or dropped, inner, above.within or tag in CONTENT_WITHIN,
                           above.article or tag in ("article", "main"), above.header or tag == "header"))
        count[tag] += 1
    put(page[at:])
    flush()
    total = sum(len(t) * content for (_, t, _, content), _ in out)
    gone = [not article and 2 * content <= total if kind == "form" else not article if kind == "class" else 2 * in_links >= chars
            for kind, article, chars, in_links, content in doubts]
    return [block for block, ds in out if not any(gone[d] for d in ds)]


def path_scores(found: list[Block]) -> dict[str, tuple[float, int, int]]:
    """(score as a share of the page's total, characters, characters of content) of each container path of a page."""
    scores: dict[str, list] = defaultdict(lambda: [0.0, 0, 0])
    of_path: dict[int, list] = {}  # blocks of one path share the object
    for path, text, linked, content in found:
        s = of_path.setdefault(id(path), [0.0, 0, 0, path])
        s[0] += max(0, len(text) - 2 * linked)
        s[1] += len(text)
        s[2] += len(text) * content
    for weight, chars, content, path in of_path.values():
        for depth in range(len(path), 0, -1):
            s = scores[">".join(path[:depth])]
            s[0] += weight
            s[1] += chars
            s[2] += content
            weight /= 2
    total = sum(s[0] for s in scores.values())
    return {p: (s / total, chars, content) for p, (s, chars, content) in scores.items()} if total else {}


def lifted(path: str, sums: dict[str, tuple[int, int]]) -> str:
    """The container to extract when ``path`` has most votes; sums: (characters, content) of it and those above."""
    parts = path.split(">")
    for n in range(len(parts), 0, -1):
        if parts[n - 1].split(".")[0] in ("article", "main"):
            return ">".join(parts[:n])
    for n in range(len(parts) - 1, 0, -1):
        (chars, content), (below, content_below) = sums[">".join(parts[:n])], sums[">".join(parts[: n + 1])]
        if content - content_below < CONTENT_SHARE * (chars - below):
            return ">".join(parts[: n + 1])
    return parts[0]


def extract(found: list[Block], path: str | None) -> str:
    """The text of the blocks at or below ``path``; of the page's own best path, if there are none."""
    def under(p: str) -> list[str]:
        parts = tuple(p.split(">"))
        of = {id(q): q[: len(parts)] == parts for q in {id(q): q for q, *_ in found}.values()}
        return [t for q, t, *_ in found if of[id(q)]]

    texts = under(path) if path else []
    if not texts:
        own = path_scores(found)
        best = min(own, key=lambda p: (-own[p][0], p), default=None)
        texts = under(lifted(best, {p: s[1:] for p, s in own.items()})) if best else [t for _, t, *_ in found]
    return "\n\n".join(texts)


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        total: dict[tuple[str, str], list] = defaultdict(lambda: [0.0, 0, 0])  # summed per batch: a host's pages share paths
        for host, page in zip(b["host"], b["html"], strict=True):
            for p, one in path_scores(blocks(page)).items():
                t = total[host, p]
                for i, x in enumerate(one):
                    t[i] += x
        yield pd.DataFrame([(h, p, *t) for (h, p), t in total.items()], columns=["host", "path", "votes", "chars", "content"])


def consensus_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path): the path with most votes of each host, lifted."""
    p = pages.select(host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html"))
    votes = p.mapInPandas(_votes, "host string, path string, votes double, chars long, content long").groupBy("host", "path").agg(
        F.sum("votes").alias("votes"), F.sum("chars").alias("chars"), F.sum("content").alias("content"))
    votes = write_table(votes, "host-votes")
    # votes rounded, so that the order of a sum decides no tie
    best = votes.filter("votes > 0").groupBy("host").agg(F.min_by("path", F.struct(-F.round("votes", 6), "path")).alias("path"))
    best = write_table(best, "host-best")

    @F.pandas_udf("string")
    def lift(path: pd.Series, sums: pd.Series) -> pd.Series:
        return pd.Series([lifted(p, {r["path"]: (r["chars"], r["content"]) for r in s}) for p, s in zip(path, sums, strict=True)], dtype=object)

    # the winner and those above it: as many rows a host as the path is deep
    above = F.expr("transform(sequence(1, size(split(path, '>'))), n -> substring_index(path, '>', n))")
    chain = best.select("host", F.col("path").alias("best"), F.explode(above).alias("path")).join(votes, ["host", "path"])
    chain = chain.groupBy("host", "best").agg(F.collect_list(F.struct("path", "chars", "content")).alias("sums"))
    return chain.select("host", lift("best", "sums").alias("path"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    winners = write_table(consensus_paths(pages, url_col, html_col), "host-paths")

    @F.pandas_udf("string")
    def text_of(page: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([extract(blocks(h), p) for h, p in zip(page, path, strict=True)], dtype=object)

    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host_of(url_col).alias("host"))
    done = p.join(winners, "host", "left").select("page_id", "url", text_of("html", "path").alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("long"))
