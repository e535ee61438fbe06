"""Main text of web pages: site templates found by counting element subtrees per host, then the article's blocks.

Every element's subtree (tag, texts and inner elements) is hashed.  Spark counts on how many pages of a host each
subtree stands; those on at least TEMPLATE_PAGES pages and TEMPLATE_SHARE of the host's pages are the host's template
and are deleted (the share bounds them to 1 / TEMPLATE_SHARE times the elements of a page).  Inside an article or main
element the recurring BOXES go: those in at least TEMPLATE_PAGES different articles (or main elements) of a host, whatever
its size.  Copies of one article count once, so a copied article stays; paragraphs, headings and cells inside are never
deleted for recurring, nor is what would leave no text at all.  What never is main text goes by its
tag (menus, footers, forms, scripts, ...) or by words of its class, id or role (adverts, notices, reader comments, ...).

The text is that of the article elements or of the rest of main elements, whichever is longer, else what is left of the page.  Character references
are decoded, white space in a block becomes one space, blocks are joined by a line break.

Edge cases: null or empty html gives an empty text; malformed markup is read leniently (open elements end with what
they stand in); pages without a host share no template; null page_ids and repeated rows are pages like others.  Columns
named like an added one are replaced.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmap.llm.common import checked_broadcast, replace_columns, with_fields, written

TEMPLATE_PAGES, TEMPLATE_SHARE = 5, 0.05

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = RAW | frozenset("nav footer aside form noscript template svg math select button dialog object canvas audio video head menu".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead
tr ul""".split())
#: Inside an article or main element these may recur as a part of the template.
BOXES = frozenset("address center details div dl fieldset figure footer header ol search section table ul".split())
#: An opening tag ends an open element of these kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: They can't be ended from within another element of these kinds.
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "p": {"article", "div", "section", "td", "th", "li", "body", "main"}}
#: Words of a class, id or role that mark what isn't the article, and words that may stand beside them.
_HINTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising advertorial sponsor sponsors sponsored promo promos promotion promotions "
    "banner banners cookie cookies consent gdpr notice notices alert alerts popup popups modal modals overlay overlays newsletter newsletters "
    "subscribe subscription subscriptions signup login sidebar sidebars side widget widgets nav navbar navigation menu menus breadcrumb "
    "breadcrumbs pagination pager toolbar share sharing social related recommended comment comments reply replies respond disqus discussion "
    "footer masthead skip search toc complementary contentinfo".split())
_BESIDE = frozenset(
    "area article articles bar block bottom box boxes button buttons col column container content count first float footer form global group "
    "head header holder icons inner item items large last left link links list main media module more outer overview page pages panel post "
    "posts primary reader readers right row secondary section sidebar site slot small sticky story stories tag tags text title to top unit user "
    "users wrap wrapper zone".split())
#: A hint doesn't count for an element with at least so many characters that are more than half of its article's.
MUCH_TEXT = 200
_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*+)>""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

OPEN, CLOSE, TEXT = 0, 1, 2


def _hinted(value: str) -> bool:
    """Whether a class token is made of hint words, and at most words that may stand beside them (side-by-side isn't)."""
    for token in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
        parts = [p for p in re.split(r"[^a-z]+", token) if p]
        if any(p in _HINTS for p in parts) and all(p in _HINTS or p in _BESIDE for p in parts):
            return True
    return False


def _unwanted(tag: str, attrs: str) -> int:
    """2: the element goes; 1: it goes by the words of its class, id or role, unless it holds most of its article; 0: it stays."""
    if tag in DROPPED:
        return 2
    if not attrs or tag in ("html", "body", "article", "main") and "comment" not in attrs.lower():
        return 0
    found = 0
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return 2
        if name in ("class", "id", "role") and _hinted(value):
            found = 1
    return found


def parse(page: str | None) -> list[list]:
    """Events [OPEN, tag, unwanted, subtree hash, characters], [CLOSE, tag] and [TEXT, text] in page order, always balanced."""
    page, events, stack, at = page or "", [], [], 0
    open_tags: Counter = Counter()  # so that no end tag looks through the whole stack in vain
    last = max(page.rfind(">"), page.rfind("<!--"))  # behind it no tag ends

    def close() -> None:
        opened, parts = stack.pop()
        open_tags[opened[1]] -= 1
        raw = "\x1f".join(parts).encode("utf-8", "surrogatepass")
        opened[3] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)
        events.append([CLOSE, opened[1]])
        if stack:
            stack[-1][1].append(str(opened[3]))
            stack[-1][0][4] += opened[4]

    def text(s: str) -> None:
        if s:
            events.append([TEXT, html.unescape(s)])
            if stack and s.strip():
                words = " ".join(s.split())
                stack[-1][1].append(words)
                stack[-1][0][4] += len(words)

    while at <= last and (m := _TOKEN.search(page, at)):
        text(page[at:m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                text(html.escape(m[0][9:-3], quote=False))
            continue
        tag = m[2].lower()
        if m[1]:
            if open_tags[tag]:
                while stack[-1][0][1] != tag:
                    close()
                close()
            elif tag in ("br", "p"):
                events += [[OPEN, tag, 0, 0, 0], [CLOSE, tag]]
            continue
        ends = ENDS.get(tag, {"p"} if tag in BLOCKS else set())
        if tag in BLOCKS:
            ends = ends | {"p"}
        for k in range(len(stack) - 1, -1, -1) if any(open_tags[t] for t in ends) else ():
            name = stack[k][0][1]
            if name in ends:
                while len(stack) > k:
                    close()
            elif name in SCOPES.get(tag, SCOPES["p"]):
                break
        opened = [OPEN, tag, _unwanted(tag, m[3]), 0, 0]
        events.append(opened)
        stack.append((opened, [tag]))
        open_tags[tag] += 1
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            close()
        elif tag in RAW:
            end = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
            stack[-1][1].append(page[at:end.start() if end else len(page)].strip())
            at = end.start() if end else len(page)
    text(page[at:])
    while stack:
        close()
    return events


def subtrees(events: list[list]) -> list[int]:
    """Distinct hashes of the page's boxes outside of article and main elements."""
    out, inside = set(), 0
    for e in events:
        if e[0] == OPEN and e[1] in ("article", "main"):
            inside += 1
        elif e[0] == CLOSE and e[1] in ("article", "main"):
            inside -= 1
        elif e[0] == OPEN and not inside and e[1] in BOXES:
            out.add(e[3])
    return sorted(out)


def inner_boxes(events: list[list]) -> list[tuple[int, int]]:
    """Distinct (hash of a box, hash of the article or main element that it stands in) of the page."""
    out, around = set(), []
    for e in events:
        if e[1] in ("article", "main") and e[0] != TEXT:
            around.append(e[3]) if e[0] == OPEN else around.pop()
        elif e[0] == OPEN and around and e[1] in BOXES:
            out.add((e[3], around[-1]))
    return sorted(out)


def main_text(events: list[list], template: frozenset | set = frozenset(), boxes: frozenset | set = frozenset()) -> str:
    """``template``: subtrees to delete outside of article and main elements; ``boxes``: inside of them."""
    found: dict[str, list[str]] = {"article": [], "main": [], "": []}
    run: list[str] = []
    open_, skip, around = {"article": 0, "main": 0}, 0, []

    def block() -> None:
        s = " ".join("".join(run).split())
        run.clear()
        if s:
            found["article" if open_["article"] else "main" if open_["main"] else ""].append(s)

    for e in events:
        if e[0] == TEXT:
            if not skip:
                run.append(e[1])
            continue
        tag = e[1]
        if skip:
            skip += 1 if e[0] == OPEN else -1
            continue
        inner = open_["article"] or open_["main"]
        if tag in BLOCKS:
            block()
        elif tag == "br" and e[0] == OPEN:
            run.append(" ")
        if e[0] == OPEN:
            most = around and e[4] >= MUCH_TEXT and 2 * e[4] > around[-1]
            if (e[2] == 2 or e[2] and not most or tag == "header" and not inner or inner and tag in BOXES and e[3] in boxes
                    or not inner and e[3] in template and tag in BOXES):
                skip = 1
            elif tag in open_:
                open_[tag] += 1
                around.append(e[4])
        elif tag in open_:
            open_[tag] -= 1
            around.pop()
    block()
    article, main = "\n".join(found["article"]), "\n".join(found["main"])
    if boxes and not article and not main:
        return main_text(events, template)
    text = (main if len(main) > len(article) else article) or "\n".join(found[""])
    return text if text or not template else main_text(events, boxes=boxes)  # a page that recurs as a whole is no template


def site_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, template): per host the hashes of the boxes that recur on many of its pages."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, keys = [], []
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                some = [0, *subtrees(parse(page))]  # 0 counts the page itself
                hosts += [host] * len(some)
                keys += some
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64())], names=["host", "key"])

    rows = pages.select(host_of(url_col).alias("host"), F.col(html_col)).where("host <> ''")
    counts = (rows.mapInArrow(hashes, "host string, key long").groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(f"key = 0 or n >= {TEMPLATE_PAGES}"))
    counts = written(counts, "html-subtrees")
    whole = counts.where("key = 0").select("host", F.col("n").alias("pages"))
    return (counts.where("key <> 0").join(whole, "host").where(F.col("n") >= F.col("pages") * TEMPLATE_SHARE)
            .groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("template")))


def box_hits(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, page, boxes): by the md5 of its html, each page's boxes that recur in articles or main elements of its host."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(host, page, *box) for host, page, text in zip(*[c.to_pylist() for c in b.columns]) for box in inner_boxes(parse(text))]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["host", "page", "key", "around"])

    boxes = (pages.select(host_of(url_col).alias("host"), F.md5(F.col(html_col).cast("binary")).alias("page"), F.col(html_col)).where("host <> ''")
             .mapInArrow(found, "host string, page string, key long, around long"))
    boxes = written(boxes, "html-boxes")
    often = boxes.groupBy("host", "key").agg(F.countDistinct("around").alias("n")).where(f"n >= {TEMPLATE_PAGES}").select("host", "key")
    often, _ = checked_broadcast(written(often, "html-often"))
    return boxes.join(often, ["host", "key"]).groupBy("host", "page").agg(F.sort_array(F.collect_set("key")).alias("boxes"))


def host_of(url_col: str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


def _different(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """``pages`` with one of each host's pages that are equal as a whole: copies say nothing about a template.

    Only hosts and hashes are counted and, where there are copies, numbered; no page is moved for it unless its host has copies of it.
    """
    keyed = pages.select(F.col(url_col), F.col(html_col), host_of(url_col).alias("__host"), F.md5(F.col(html_col).cast("binary")).alias("__page"))
    copies = written(keyed.groupBy("__host", "__page").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__host", "__page"), "html-copies")
    again, _ = checked_broadcast(copies)
    one = keyed.join(again, ["__host", "__page"], "left_semi").dropDuplicates(["__host", "__page"])
    return keyed.join(again, ["__host", "__page"], "left_anti").unionByName(one).select(url_col, html_col)


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """All rows and columns of ``pages`` but the html, with text and n_chars."""
    templates, _ = checked_broadcast(written(site_templates(_different(pages, url_col, html_col), url_col, html_col), "html-templates"), 20_000)
    hits, _ = checked_broadcast(written(box_hits(pages, url_col, html_col), "html-hits"), 20_000)
    base = replace_columns(pages, ["text", "n_chars"])
    rows = base.withColumns({"__host": host_of(url_col), "__page": F.md5(F.col(html_col).cast("binary"))})
    rows = rows.join(templates.withColumnRenamed("host", "__host"), "__host", "left")
    rows = rows.join(hits.select(F.col("host").alias("__host"), F.col("page").alias("__page"), F.col("boxes").alias("__boxes")),
                     ["__host", "__page"], "left").drop("__host", "__page")
    out = [c for c in base.columns if c != html_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            texts = [main_text(parse(page), set(t or ()), set(x or ()))
                     for page, t, x in zip(*[col[c].to_pylist() for c in (html_col, "template", "__boxes")])]
            yield pa.RecordBatch.from_arrays([*[col[c] for c in out], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=[*out, "text", "n_chars"])

    return rows.mapInArrow(run, with_fields(base.select(*[f"`{c}`" for c in out]), text="string", n_chars="long"))
