"""Main-text extraction by consensus host paths.

The lowest container that holds all text of a page outside boilerplate and links is its own choice. The
generalised tag-class path of it is the page's vote, votes are counted per host in Spark, and each page is
then read again through the winning paths of its host: the nodes that lie on the path with most votes are
its article, if they hold all of that text. A page on which no winning path does uses its own choice. So
paths settle which links around the text belong to it, and no text is lost to them.

A class names boilerplate only on a block, and only if nothing but words of layout stands beside the name; an id only with its
place or links as evidence; headings, rows, cells, list items and inline elements are never dropped for a name, nor is a wrapper of
the article (Page._settle). Inside the article, boilerplate subtrees (menus, headers, footers, sidebars, notices, adverts, forms,
reader comments, scripts, styles) are left out. Blocks are joined by one newline, white space inside a
block becomes one space, character references are decoded once.

Defined cases: null or empty html gives the empty text; a null url belongs to the host ''; an empty
table gives no rows; repeated rows vote and are returned each for itself; other columns are not read.
Very long pages are parsed in one pass, whose cost grows with their length also where quotation marks or tags are never closed.
"""

from __future__ import annotations

import html as _html
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, settle, small_batches

#: A path is a winner of its host if it has this share of the host's votes.
WIN_SHARE = 0.2
#: A host has at most 1 / WIN_SHARE paths, some hundred characters each: about 10 MB in all.
BROADCAST_HOSTS, SALT = 10_000, 32

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|svg|object|select|title|xmp|noembed|noframes|canvas|video|audio"
SKIP_TAGS = frozenset("head nav header footer aside form button menu dialog".split()) | frozenset(RAW.split("|"))
BLOCKS = frozenset("p div section article main body html ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre h1 h2 h3 h4 h5 h6 hr br figure address details summary center hgroup nav header footer aside form fieldset legend figcaption".split())
CONTAINERS = frozenset("body html div section article main td blockquote center figure".split())
#: Blocks of running text.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre".split())
#: An open p ends where one of these begins.
ENDS_P = BLOCKS - {"br", "html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption"}
SKIP_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
    "newsletter subscribe subscription signup sidebar sidenav aside menu nav navbar navigation breadcrumb breadcrumbs footer footnav header masthead topbar toolbar "
    "comment comments commentlist reply replies respond disqus social share sharing related recommended popup modal overlay widget pagination pager login search skip".split()
)
#: A skip name beside only such words still names the element (comment-list, ad-slot, main-nav); beside any other word it may
#: say what the text is about (job-search, topic-social).
PARTS = frozenset(
    "area article bar block blog desktop entry global mobile page post site small top block body bottom box button buttons btn col column container content count entry field fixed form group head heading icon icons inner input item items left "
    "link links list main menu outer panel posts primary right row secondary section slot text thread title toggle top unit widget widgets wrap wrapper zone".split()
)
#: Beside one of these, `header` is a part of the text's own (section-header).
OF_TEXT = frozenset("article block content entry heading item list post section text thread title".split())
#: Elements that a class may name boilerplate. Headings, rows, cells, list items and inline elements are never dropped for a name.
NAMED_TAGS = frozenset("div section ul ol dl table center p figure".split())
#: Names that an id alone may give a div or section, wherever it is; other ids need more: being outside the article, or mostly links.
ID_NAMES = frozenset("comment comments commentlist disqus respond cookie cookies consent gdpr ad ads advert adverts advertisement adsense".split())
#: Behind one of these a skip name only tells what the element has around it or lacks (has-sidebar).
NOT_NAMES = frozenset("has have no not non without with hide is show".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
TAG_NAME, GAP, BARE, SPACE = re.compile(r"[^\s/>]+"), re.compile(r"[^>=]*"), re.compile(r"[^\s>]*"), re.compile(r"\s*")
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW.split("|")}
#: Attributes that say whether an element is shown and what it is.
READ = frozenset("class id role hidden aria-hidden style".split())
NAME = re.compile(r"[a-z]+")
DIGITS = re.compile(r"\d+")
HOST = re.compile(r"\A[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


#: Reasons to drop an element: its name, role or being a form; another tag of SKIP_TAGS; never shown as text; an id that only hints.
NAMED, TAGGED, FIRM, HINTED = 1, 2, 3, 4
HIDDEN_TAGS = frozenset(["head", *RAW.split("|")])


def names_boilerplate(token: str) -> bool:
    """Whether a class or id token names boilerplate: a skip name, beside nothing but other ones and PARTS."""
    words = NAME.findall(token)
    if SKIP_NAMES.intersection(words) == {"header"} and OF_TEXT.intersection(words):
        return False
    return any(w in SKIP_NAMES for w in words) and all(w in PARTS or w in SKIP_NAMES for w in words) and (words[0] in SKIP_NAMES or words[-1] in SKIP_NAMES)


def tags(source: str):
    """(start, end, name, closing, attributes of READ) of each tag, in one pass; comments, declarations and raw elements have no name.

    A quotation mark opens a value only behind an equals sign, and a value may be of any length and hold any sign. Where the
    tags of a page run past its last '>', because a value is never closed, tags end at the next '>' from there on. So each
    part of a page is looked at twice at most.
    """
    at, n, last, strict, gone = 0, len(source), source.rfind(">"), True, set()

    def attributes(i: int):
        """(place of the tag's '>', attributes read), or -1 if there is none."""
        nonlocal strict
        read: dict[str, str] = {}
        while True:
            gap = GAP.match(source, i)
            names, i = gap[0].replace("/", " ").lower().split(), gap.end()
            read |= dict.fromkeys(READ.intersection(names), "")
            if i >= n:
                return -1, read
            if source[i] == ">":
                return i, read
            i = SPACE.match(source, i + 1).end()
            quote = source[i : i + 1]
            if quote in ("'", '"'):
                end = -1 if quote in gone else source.find(quote, i + 1)
                if end < 0:
                    gone.add(quote)
                    return source.find(">", i), read
                value, i = (i + 1, end), end + 1
            else:
                end = BARE.match(source, i).end()
                value, i = (i, end), end
            if names and names[-1] in READ:
                read[names[-1]] = source[value[0] : value[1]].lower()

    while True:
        i = source.find("<", at)
        if i < 0 or i > last:
            return
        head = source[i + 1 : i + 2]
        name, closing, read = "", head == "/", {}
        if source.startswith("<!--", i):
            end = source.find("-->", i + 2)
            end = end + 3 if end >= 0 else n
        elif head in ("!", "?", "/"):
            end = source.find(">", i) + 1
            if closing and source[i + 2 : i + 3].isalpha():
                name = TAG_NAME.match(source, i + 2)[0].lower()
        elif head.isascii() and head.isalpha():
            name = TAG_NAME.match(source, i + 1)[0].lower()
            end, read = attributes(i + 1 + len(name)) if strict else (-1, {})
            if end < 0:
                strict, end = False, source.find(">", i)
                if name not in RAW_END:
                    read = {k: v for k, v in _loose(source[i + 1 + len(name) : end]).items() if k in READ}
            end += 1
            if name in RAW_END:
                if source[end - 2] != "/":
                    m = RAW_END[name].search(source, end)
                    end = m.end() if m else n
                name = ""
        else:
            at = i + 1
            continue
        yield i, end, name, closing, read
        at = end


def _loose(text: str) -> dict[str, str]:
    """Attributes of a tag that ends at its first '>', quotation marks or not."""
    return {k.lower(): v.strip("\"'").lower() for k, v in re.findall(r"([^\s=\"'/]+)(?:\s*=\s*([^\s>]*))?", text)}


class Page:
    """Elements of a page in page order: parallel lists tag, path, parent, skip, drop (why it may be skipped itself); pieces (element, text or None for a break)."""

    def __init__(self, source: str):
        self.tag, self.path, self.parent, self.skip, self.link = ["#"], [""], [-1], [False], [False]
        self.drop = [0]
        self.pieces: list[tuple[int, str | None]] = []
        stack, at = [0], 0
        for start, end, name, closing, read in tags(source):
            if start > at:
                self.pieces.append((stack[-1], source[at:start]))
            at = end
            if not name:
                continue
            if closing:
                if name in BLOCKS:
                    self.pieces.append((stack[-1], None))
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == name:
                        del stack[k:]
                        break
                    if name not in BLOCKS and self.tag[stack[k]] in CONTAINERS:
                        break  # a stray inline end tag does not close containers
                continue
            if name in BLOCKS:
                self.pieces.append((stack[-1], None))
            if name in VOID:
                continue
            if name in ENDS_P:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == "p":
                        del stack[k:]
                        break
                    if self.tag[stack[k]] in CONTAINERS:
                        break
            if name == "li":
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == "li":
                        del stack[k:]
                        break
                    if self.tag[stack[k]] in ("ul", "ol", *CONTAINERS):
                        break
            self._open(name, read, stack)
        if at < len(source):
            self.pieces.append((stack[-1], source[at:]))
        self._settle()

    def _open(self, name: str, read: dict[str, str], stack: list[int]) -> None:
        up = stack[-1]
        drop = FIRM if name in HIDDEN_TAGS else TAGGED if name in SKIP_TAGS and name != "form" else NAMED if name == "form" else 0
        classes = read.get("class", "").split()
        if name in NAMED_TAGS and any(map(names_boilerplate, classes)):
            drop = max(drop, NAMED)
        ids = [x for x in read.get("id", "").split() if names_boilerplate(x)] if name in ("div", "section") else []
        if any(ID_NAMES.intersection(NAME.findall(x)) for x in ids):
            drop = max(drop, NAMED)
        elif ids and not drop:
            drop = HINTED
        if read.get("role", "").strip() in SKIP_ROLES and name not in ("html", "body", "article", "main"):
            drop = NAMED if drop in (0, HINTED) else drop
        if "hidden" in read or read.get("aria-hidden") == "true" or "display:none" in read.get("style", "").replace(" ", ""):
            drop = FIRM
        self.tag.append(name)
        self.parent.append(up)
        self.skip.append(False)
        self.drop.append(drop)
        self.link.append(self.link[up] or name == "a")
        if name in CONTAINERS:
            self.path.append(self.path[up] + "/" + ".".join([name, *sorted(DIGITS.sub("#", c) for c in set(classes))]))
        else:
            self.path.append(self.path[up])
        if name not in VOID:
            stack.append(len(self.tag) - 1)

    def _settle(self) -> None:
        """skip: below an element with a reason to drop it, unless that element is a wrapper of the page's article.

        A wrapper holds a main; or, if only its name, role or being a form speaks against it, all articles of the page
        that would otherwise be lost, or most of the page's text while next to nothing would be left beside it.
        """
        n = len(self.tag)
        self._weigh_hints(n)
        firm, under, size, left = [False] * n, [False] * n, [0] * n, 0
        for k in range(1, n):
            firm[k] = firm[self.parent[k]] or self.drop[k] == FIRM
            under[k] = under[self.parent[k]] or self.drop[k] > 0
        for node, text in self.pieces:
            if text is not None and not firm[node] and not self.link[node]:
                size[node] += (m := len(text.strip()))
                left += 0 if under[node] else m
        main, article = [not firm[k] and self.tag[k] == "main" for k in range(n)], [not firm[k] and self.tag[k] == "article" for k in range(n)]
        kept = any(not under[k] and (main[k] or article[k]) for k in range(n))
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            size[up] += size[k]
            main[up] |= main[k]
            article[up] |= article[k]
        for k in range(1, n):
            drop = self.drop[k]
            if drop in (NAMED, TAGGED) and not self.skip[self.parent[k]]:
                most = 2 * size[k] > size[0] and size[k] >= 9 * left
                if main[k] or drop == NAMED and (most or article[k] and not kept):
                    drop = 0
            self.skip[k] = self.skip[self.parent[k]] or drop > 0

    def _weigh_hints(self, n: int) -> None:
        """An id speaks against an element that is mostly links, or lies outside the article or main that the page has."""
        if HINTED not in self.drop:
            return
        text, links, inside = [0] * n, [0] * n, [t in ("article", "main") for t in self.tag]
        for node, piece in self.pieces:
            if piece is not None:
                text[node] += (m := len(piece.strip()))
                links[node] += m if self.link[node] else 0
        holds = inside[:]
        for k in range(n - 1, 0, -1):
            text[self.parent[k]] += text[k]
            links[self.parent[k]] += links[k]
            holds[self.parent[k]] |= holds[k]
        for k in range(1, n):
            inside[k] |= inside[self.parent[k]]
            if self.drop[k] == HINTED:
                self.drop[k] = NAMED if 2 * links[k] > text[k] or holds[0] and not inside[k] and not holds[k] else 0

    def sizes(self) -> list[int]:
        """Each element's characters of text below it that is not skipped, without links; with links, if the page has no other."""
        own, links = [0] * len(self.tag), [0] * len(self.tag)
        for node, text in self.pieces:
            if text is not None and not self.skip[node]:
                (links if self.link[node] else own)[node] += len(text.strip())
        total = own if any(own) else links
        for k in range(len(total) - 1, 0, -1):
            total[self.parent[k]] += total[k]
        return total

    def text(self, roots: list[int]) -> str:
        """The blocks below the roots (none below another), in page order, in one pass."""
        root = [-1] * len(self.tag)
        for k in roots:
            root[k] = k
        for k in range(min(roots) + 1, len(self.tag)):
            if root[k] < 0:
                root[k] = root[self.parent[k]]
        blocks, now, last = [], [], -1
        for node, piece in self.pieces:
            if (piece is None or root[node] != last) and now:
                blocks.append("".join(now))
                now = []
            last = root[node]
            if piece is not None and last >= 0 and not self.skip[node]:
                now.append(piece)
        blocks.append("".join(now))
        return "\n".join(b for b in (" ".join(_html.unescape(x).split()) for x in blocks) if b)


def best(page: Page) -> tuple[int, list[int]]:
    """The article's container: the lowest one that holds all of the page's text outside skipped elements and links.

    In an article or main element, that element; elsewhere its parent, as long as what the parent has beside it are
    paragraphs and headings: these may be links only, and still belong to the text. Lists and other blocks of links don't.
    """
    sizes = page.sizes()
    if not sizes[0]:
        return 0, sizes
    own = max(k for k, n in enumerate(sizes) if n == sizes[0] and (page.tag[k] in CONTAINERS or k == 0))
    up, whole = own, own
    while up > 0:
        if page.tag[up] in ("article", "main") and not page.skip[up]:
            whole = up
        up = page.parent[up]
    if whole != own or page.tag[own] in ("article", "main"):
        return whole, sizes
    n = len(page.tag)
    box, prose = list(range(n)), [True] * n  # each element's nearest container, and whether only blocks of running text lie between
    for k in range(1, n):
        if page.tag[k] not in CONTAINERS:
            up = page.parent[k]
            box[k], prose[k] = box[up], page.tag[k] in PROSE or page.tag[k] not in BLOCKS and up != box[up] and prose[up]
    all_, mine = [0] * n, [0] * n
    for node, text in page.pieces:
        if text is not None and not page.skip[node]:
            all_[node] += (m := len(text.strip()))
            mine[box[node]] += m if prose[node] and node != box[node] else 0
    for k in range(n - 1, 0, -1):
        all_[page.parent[k]] += all_[k]
    while own > 0 and page.tag[up := page.parent[own]] in ("div", "section") and mine[up] and all_[up] == all_[own] + mine[up]:
        own = up
    return own, sizes


def extract(source: str | None, winners: list[str]) -> tuple[str, str]:
    """(text, path used) of one page, by its host's winning paths, most votes first."""
    if not source:
        return "", ""
    page = Page(source)
    own, sizes = best(page)
    on_path: dict[str, list[int]] = {}
    for k, p in enumerate(page.path):
        if page.tag[k] in CONTAINERS or k == 0:
            on_path.setdefault(p, []).append(k)
    for path in winners:
        nodes = [k for k in on_path.get(path, []) if not page.skip[k]]
        if nodes and sum(sizes[k] for k in nodes) == sizes[0]:
            text = page.text(nodes)
            if text:
                return text, path
    return page.text([own]), page.path[own]


def _host(url) -> str:
    m = HOST.match(url) if isinstance(url, str) else None
    return m[1].lower() if m else ""


def _votes(batches):
    for pdf in chunks(batches, "html"):
        rows = []
        for url, source in zip(pdf["url"], pdf["html"], strict=True):
            if isinstance(source, str) and source:
                page = Page(source)
                rows.append((_host(url), page.path[best(page)[0]]))
        yield pd.DataFrame(rows, columns=["host", "path"])


def host_paths(pages: DataFrame) -> DataFrame:
    """pages(url, html) -> host, paths: the winning paths, most votes first. At most 1 / WIN_SHARE paths a host."""
    small_batches(pages.sparkSession)
    votes = pages.select("url", "html").mapInPandas(_votes, "host string, path string").groupBy("host", "path").count()
    whole = Window.partitionBy("host")
    won = votes.withColumn("all", F.sum("count").over(whole)).filter(F.col("count") >= WIN_SHARE * F.col("all"))
    ranked = won.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "path"))).alias("r"))
    return ranked.select("host", F.transform("r", lambda x: x["path"]).alias("paths"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars, path.

    The hosts' paths are broadcast if they are at most BROADCAST_HOSTS rows; else each host's pages are dealt to SALT parts.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    host = F.lower(F.coalesce(F.regexp_extract("url", HOST.pattern.replace(r"\A", "^"), 1), F.lit("")))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    paths = settle(host_paths(pages), "paths")
    if paths.count() <= BROADCAST_HOSTS:
        rows = rows.join(F.broadcast(paths), "host", "left")
    else:
        salted = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("url", "page_id"), F.lit(SALT)).cast("int")).hint("merge").join(salted, ["host", "salt"], "left")
    rows = rows.select("page_id", "url", "html", "paths")

    def again(batches):
        for pdf in chunks(batches, "html"):
            found = [extract(h if isinstance(h, str) else None, list(p) if p is not None else []) for h, p in zip(pdf["html"], pdf["paths"], strict=True)]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": [t for t, _ in found], "n_chars": [len(t) for t, _ in found], "path": [p for _, p in found]})

    return rows.mapInPandas(again, f"page_id {kind}, url string, text string, n_chars long, path string")
