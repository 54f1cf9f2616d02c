"""Main text of web pages, by containers that the pages of a host agree on.

Each page is read once to score its containers: text outside of boilerplate counts
for a container, all other text in it against it. The best one's path, tags and
classes with digits generalised, is the page's vote; Spark adds the votes up per
host, and every page is read again: where the host's winning path leads to a
container with text, that is the article, elsewhere the page's own best one.

Votes are counted in each task before the shuffle, so a host of many pages is no hot
key; the winners go to the pages by a broadcast if they are few, else by a join that
Spark can split.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, small_side, table

#: Tags that begin and end a block of text; those of them that can hold an article, and those that end when the next one begins.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend "
    "li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article blockquote body center details div fieldset form html main section table tbody td".split())
SIBLINGS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What a sibling is not looked for behind.
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "p": {"td", "th", "div", "article", "section", "body"}}
#: Content without markup, which is skipped; empty elements; elements and roles that are no part of an article.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("aside audio button canvas dialog dir footer head menu nav noscript object search select svg template video".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Words of class and id of what is no part of an article.
WORDS = frozenset(
    "ad ads adsense advert advertisement advertisements advertising adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus feedback footer gdpr "
    "login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion recommended related replies search share sharebar sharing sidebar "
    "signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Words before which the former speak of the layout.
LAYOUT = frozenset("has no with without".split())
LIKELY = frozenset("article articlebody body content entry main post story text".split())
_TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|/[^a-zA-Z>][^>]*(?:>|\Z)|/>|(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)(>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_DIGITS = re.compile(r"[0-9]+")


class Page(NamedTuple):
    """Elements in page order, each behind its parent, and blocks of text: (element, text, characters in links)."""

    parent: list[int]
    name: list[str]
    dropped: list[bool]
    bonus: list[float]
    blocks: list[tuple[int, str, int]]


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTRIBUTE.finditer(text)))}  # the first of a name counts


def class_words(own: dict[str, str]) -> list[str]:
    return [w.lower() for key in ("class", "id") for w in _PARTS.findall(own.get(key, ""))]


def boilerplate(words: list[str]) -> bool:
    return any(w in WORDS and (i == 0 or words[i - 1] not in LAYOUT) for i, w in enumerate(words))


def read(html: str) -> Page:
    """Elements and blocks of a page; tags that are left open end where their parents do."""
    parent, name, tags, sure, maybe, bonus = [-1], [""], ["#"], [False], [False], [1.0]
    stack, opened, blocks = [0], {}, []
    held: list[str] = []
    linked, link, at, within = 0, -1, 0, 0  # within: open articles

    def flush():
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                blocks.append((stack[-1], text, linked))
            held.clear()
            linked = 0

    def close(upto: int):
        nonlocal within, link
        while len(stack) > upto:
            node = stack.pop()
            opened[tags[node]] -= 1
            within -= tags[node] in ("article", "main")
            if link == node:
                link = -1

    end = len(html)
    while at < end:
        m = _TAG.search(html, at)
        text = html[at : m.start() if m else end]
        if text:
            text = unescape(text) if "&" in text else text
            held.append(text)
            if link >= 0:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        if not m[4]:  # an unfinished tag
            break
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link = -1
            elif tag not in ("body", "html") and opened.get(tag):
                if tag in BLOCKS:
                    flush()
                k = len(stack) - 1
                while tags[stack[k]] != tag:
                    k -= 1
                if tag not in BLOCKS:
                    held.append(" ") if tag in DROPPED else None
                    flush()
                close(k)
            elif tag == "p":
                flush()
            continue
        if tag in RAW:
            done = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = done.end() if done else end
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag == "a":
            link = stack[-1]
            continue
        block = tag in BLOCKS
        own = attributes(m[3]) if m[3] and not m[3].isspace() else {}
        if not block and tag not in DROPPED and not own:
            continue
        words = class_words(own) if own else []
        hidden = bool(own) and ("hidden" in own or own.get("aria-hidden", "").lower() == "true" or "display:none" in own.get("style", "").replace(" ", "").lower())
        chrome = bool(own) and (own.get("role", "").lower() in ROLES or boilerplate(words))
        if not block and tag not in DROPPED and not (hidden or chrome):
            continue
        if tag in VOID:
            flush() if block else None
            continue
        flush()
        if tag in SIBLINGS and any(opened.get(x) for x in SIBLINGS[tag]):
            k = len(stack) - 1
            while k and tags[stack[k]] not in SIBLINGS[tag] and tags[stack[k]] not in SCOPES[tag]:
                k -= 1
            if tags[stack[k]] in SIBLINGS[tag]:
                close(k)
        elif block and tags[stack[-1]] == "p":
            close(len(stack) - 1)
        header = tag == "header" or "header" in words
        classes = sorted({_DIGITS.sub("#", c) for c in own.get("class", "").split()})
        parent.append(stack[-1])
        name.append(".".join([tag, *classes]))
        tags.append(tag)
        sure.append(tag in DROPPED or hidden or tag == "header" and not within)
        maybe.append(tag not in ("html", "body", "main") and (tag == "form" or chrome or header and not within))
        likely = own.get("itemprop", "").lower() == "articlebody" or own.get("role", "").lower() in ("main", "article") or any(w in LIKELY for w in words)
        bonus.append(1.3 if tag == "article" else 1.1 if tag == "main" or likely else 1.0)
        stack.append(len(tags) - 1)
        opened[tag] = opened.get(tag, 0) + 1
        within += tag in ("article", "main")
    flush()
    # what holds an article is no boilerplate by its class, nor is a form around most of the page
    holds, size = [t in ("article", "main") and not m for t, m in zip(tags, maybe, strict=True)], [0] * len(tags)
    for node, text, _ in blocks:
        size[node] += len(text)
    for node in range(len(tags) - 1, 0, -1):
        holds[parent[node]] |= holds[node]
        size[parent[node]] += size[node]
    dropped = [False]
    for node in range(1, len(tags)):
        layout = tags[node] not in ("article", "main") and holds[node] or tags[node] == "form" and 2 * size[node] > size[0]
        dropped.append(dropped[parent[node]] or sure[node] or maybe[node] and not layout)
    bonus = [b if t in CONTAINERS or node == 0 else 0.0 for node, (b, t) in enumerate(zip(bonus, tags, strict=True))]
    return Page(parent, name, dropped, bonus, blocks)


def scores(page: Page) -> list[float]:
    """Of each container: the article's text in it, times its share of all text there. Links count a fifth."""
    good, total = [0.0] * len(page.parent), [0] * len(page.parent)
    for node, text, linked in page.blocks:
        total[node] += len(text)
        if not page.dropped[node]:
            good[node] += len(text) - 0.8 * min(linked, len(text))
    for node in range(len(good) - 1, 0, -1):
        good[page.parent[node]] += good[node]
        total[page.parent[node]] += total[node]
    return [b * g * g / t if t else 0.0 for b, g, t in zip(page.bonus, good, total, strict=True)]


def best(page: Page, own: list[float]) -> int:
    """The container of the highest score; of nested equals the inner one, else the first."""
    found = 0
    for node in range(1, len(own)):
        if own[node] > own[found]:
            found = node
        elif own[node] == own[found] and own[node] > 0:
            up = page.parent[node]
            while up > found:
                up = page.parent[up]
            found = node if up == found else found
    return found


def path(page: Page, node: int) -> str:
    out = []
    while node > 0:
        out.append(page.name[node])
        node = page.parent[node]
    return ">".join(reversed(out))


def at_path(page: Page, own: list[float], wanted: str) -> int | None:
    """The container of the highest score among those at a path, if any has text."""
    names, found = wanted.split(">") if wanted else [], None
    for node in range(len(own)):
        if own[node] > 0 and (found is None or own[node] > own[found]):
            up, k = node, len(names) - 1
            while up > 0 and k >= 0 and page.name[up] == names[k]:
                up, k = page.parent[up], k - 1
            if up == 0 and k == -1:
                found = node
    return found


def text_of(page: Page, node: int) -> str:
    inside = [False] * len(page.parent)
    inside[node] = True
    for k in range(node + 1, len(inside)):
        inside[k] = inside[page.parent[k]]
    return "\n".join(text for k, text, _ in page.blocks if inside[k] and not page.dropped[k])


def host(url) -> F.Column:
    """Host of an address, without user and port; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1))
    return F.when(found != "", found)


def winning_paths(pages: DataFrame) -> DataFrame:
    """``host, path``: the path that most pages of a host vote for; ties go to the least one."""

    def vote(batches):
        for batch in batches:
            paths = []
            for html in batch.column("html").to_pylist():
                page = read(html)
                own = scores(page)
                node = best(page, own)
                paths.append(path(page, node) if own[node] > 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], ["host", "path"])

    voting = pages.select(host(F.col("url")).alias("host"), "html").where("host is not null and html <> ''")
    votes = voting.mapInArrow(vote, "host string, path string").where("path is not null").groupBy("host", "path").count()
    first = F.min(F.struct(-F.col("count"), "path")).alias("first")
    return materialize(votes.groupBy("host").agg(first).select("host", "first.path"), "host-paths")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, path`` of every row of ``pages (page_id, url, html)``.

    Null and empty html have an empty text; pages whose address names no host take
    their own best container, ``path`` is null where no text was found. Rows are judged
    one by one, repeated ones too; other columns play no part.
    """
    winners = small_side(winning_paths(pages), 200)

    def run(batches):
        for batch in batches:
            texts, paths = [], []
            for html, wanted in zip(batch.column("html").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                page = read(html or "")
                own = scores(page)
                node = at_path(page, own, wanted) if wanted is not None else None
                node = best(page, own) if node is None else node
                texts.append(text_of(page, node))
                paths.append(path(page, node) if own[node] > 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(paths, pa.string())], ["page_id", "url", "text", "n_chars", "path"])

    own = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(winners.withColumnRenamed("path", "wanted"), "host", "left")
    kind = pages.schema["page_id"].dataType.simpleString()
    return own.select("page_id", "url", "html", "wanted").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, path string")


def op13_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op13_html_extraction": op13_html_extraction}
ORACLE_SQL: dict[str, str] = {}
