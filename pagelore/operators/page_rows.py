"""Pages to rows: static text, prose blocks, page text, interactive elements and what follows from them.

One Python pass over the pages gives blocks, text and elements together; the rest is relational. Stored pages are not
rendered: hidden means the hidden attribute, aria-hidden, an inline style or type=hidden, on the element or above it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelore.functions.html_tree import Node, parse
from pagelore.functions.text import unescaped

#: Names of page chrome, and of controls.
CHROME_TAGS = frozenset("nav footer header aside script style noscript form".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search".split())
CHROME_WORDS = re.compile(r"(^|[-_ ])(nav|menu|sidebar|footer|header|banner|cookie|consent|promo|advert|subscribe|newsletter|related|comment|share|social|breadcrumb)([-_ ]|$)", re.I)
CONTROL_TAGS = frozenset("a button input select textarea details summary canvas".split())
CONTROL_ROLES = frozenset("button link checkbox radio menuitem tab textbox combobox listbox option switch treeitem slider".split())
SVG_TAGS = frozenset("svg path g rect circle ellipse polygon polyline line text use".split())
TRACKERS = ("googletagmanager.com", "google-analytics.com", "facebook.net", "hotjar.com", "sentry.io", "recaptcha.net", "doubleclick.net", "analytics.google.com", "pixel.facebook.com", "tr.snapchat.com")
REVEAL_PHRASES = ("show more", "load more", "next", "expand", "read more", "see more")
CONSENT_LABELS = ("accept", "accept all", "accept all cookies", "accept cookies", "i agree", "agree", "allow all", "allow all cookies", "got it", "ok")
HEAVY_FILES = "png jpg jpeg gif webp avif ico bmp svg woff woff2 ttf otf eot mp4 webm ogg mp3 wav avi mov m4a".split()
TEXT_CHARS, LABEL_CHARS, VALUE_CHARS, OPTIONS = 8000, 120, 80, 50
SMALLEST_CONTAINER_WINS = 1.05
PROSE = frozenset("p li pre blockquote".split())

BLOCKS = "array<struct<block_id:int,kind:string,level:int,text:string,path:array<string>>>"
ELEMENTS = (
    "array<struct<index:int,dom_pos:int,tag:string,role:string,text:string,placeholder:string,href:string,raw_href:string,handle:string,disabled:boolean,required:boolean,checked:boolean,selected:boolean,"
    "value:string,is_combobox:boolean,combobox_expanded:boolean,combobox_options:array<string>,expanded:string,focusable:boolean,onclick:boolean,has_data:boolean,has_class:boolean,frame_host:string>>"
)


def static_text(html: Column) -> Column:
    """The page's text as a plain fetch sees it: raw elements and tags out, references decoded, white space single."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript|template)\b[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(bare, "<[^>]+>", " ")), r"(?U)\s+", " "))


def _is_chrome(node: Node) -> bool:
    a = node.attrs
    return node.tag in CHROME_TAGS or a.get("role", "") in CHROME_ROLES or bool(CHROME_WORDS.search(a.get("class", "")) or CHROME_WORDS.search(a.get("id", "")))


def _container(root: Node) -> Node:
    body = next((n for n in root.walk() if n.tag == "body"), root)
    named = next((n for n in root.walk() if n.tag in ("article", "main") or n.attrs.get("role") == "main"), None)
    if named is not None:
        return named
    held: dict[int, int] = {}  # prose length under each node, summed upwards once
    for node in root.walk():
        if node.tag in PROSE and not _is_chrome(node) and not (node.parent and _is_chrome(node.parent)):
            size = len(node.text())
            for up in node.above():
                if up is not node:
                    held[up.order] = held.get(up.order, 0) + size
    best, most = body, 0.0
    for node in root.walk():
        if node.tag in ("div", "section") and held.get(node.order, 0) > most * SMALLEST_CONTAINER_WINS:
            best, most = node, held[node.order]
    return best


def blocks_of(root: Node) -> list[dict]:
    """Headings, texts and code of the main container, each with the trail of headings above it."""
    out: list[dict] = []
    trail: list[tuple[int, str]] = []

    def add(kind: str, level: int, text: str) -> None:
        out.append({"block_id": len(out), "kind": kind, "level": level, "text": text, "path": [t for _, t in trail]})

    top = _container(root)
    stack = [] if _is_chrome(top) else [top]
    while stack:
        node = stack.pop()
        if re.fullmatch("h[1-6]", node.tag):
            if text := node.text():
                level = int(node.tag[1])
                trail[:] = [t for t in trail if t[0] < level] + [(level, text)]
                add("heading", level, text)
        elif node.tag in PROSE or node.tag == "td":
            nested = any(n is not node and n.tag in PROSE for n in node.walk())
            if not nested and len(text := node.text()) > 2:
                add("code" if node.tag == "pre" else "text", 0, text)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not _is_chrome(c))
    return out


def page_text_of(root: Node) -> str:
    """Text of the main part, else of the body, cut after TEXT_CHARS."""
    part = next((n for n in root.walk() if n.tag == "main" or n.attrs.get("role") == "main"), None)
    return (part or next((n for n in root.walk() if n.tag == "body"), root)).text()[:TEXT_CHARS]


def _hides(node: Node) -> bool:
    if not node.attrs:
        return False
    style = node.attrs.get("style", "").replace(" ", "").lower()
    return "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style or bool(re.search(r"opacity:0(\.0+)?(;|$)", style))


def _label(node: Node, ids: dict[str, Node], labels: dict[str, Node], labelled: bool) -> str:
    a = node.attrs
    named = " ".join(ids[i].text() for i in a.get("aria-labelledby", "").split() if i in ids)
    wrap = next((up for up in node.above() if up.tag == "label"), None) if labelled else None
    own = labels.get(a.get("id", "\0")) or wrap
    below = [n for n in node.walk() if n.tag in ("img", "title")] if any(isinstance(c, Node) for c in node.children) else [node] if node.tag in ("img", "title") else []
    image = next((n.attrs["alt"] for n in below if n.tag == "img" and n.attrs.get("alt")), "")
    title = next((n.text() for n in below if n.tag == "title"), "")
    typed = a.get("value", "") if node.tag == "input" and a.get("type", "") in ("submit", "button", "reset") else ""
    inner = "" if node.tag in ("select", "textarea") else node.text()
    return next((x for x in (a.get("aria-label", "").strip(), named, inner, own.text() if own else "", typed, image, title, a.get("title", "").strip()) if x), "")[:LABEL_CHARS]


def elements_of(root: Node, url: str) -> list[dict]:
    """Controls that aren't hidden, in page order, with label, state, options and absolute address."""
    nodes = list(root.walk())
    ids = {n.attrs["id"]: n for n in nodes if n.attrs.get("id")}
    labels = {n.attrs["for"]: n for n in nodes if n.tag == "label" and n.attrs.get("for")}
    labelled = any(n.tag == "label" for n in nodes)
    hidden: dict[int, bool] = {}  # by place: an element is hidden where one above it is
    out = []
    for node in nodes:
        a, tag = node.attrs, node.tag
        hidden[node.order] = gone = _hides(node) or (node.parent is not None and hidden[node.parent.order])
        if not a and tag not in CONTROL_TAGS and tag not in SVG_TAGS and tag != "iframe":
            continue
        role = a.get("role") or a.get("aria-role", "")
        svg = tag in SVG_TAGS and ("aria-label" in a or any(isinstance(c, Node) and c.tag == "title" for c in node.children))
        frame = tag == "iframe"
        if not (frame or tag in CONTROL_TAGS or role in CONTROL_ROLES or svg) or gone or a.get("type", "").lower() == "hidden":
            continue
        kind, host, link = a.get("type", "").lower(), None, a.get("href")
        try:
            link = urljoin(url, link) if link is not None else None
            if frame:
                found = re.match(r"[a-z][a-z0-9+.-]*://([^/?#:]*)", urljoin(url, a.get("src") or a.get("data-src", "")), re.I)
                host = found[1].lower() if found else ""
        except ValueError:
            link = None
        choices = [n for n in node.walk() if n.tag == "option"] if any(isinstance(c, Node) for c in node.children) else []
        picked = next((n for n in choices if "selected" in n.attrs), None)
        value = None if kind == "password" else picked.text() if picked is not None else a.get("value") if tag in ("input", "textarea") else None
        combo = role == "combobox" or "list" in a or a.get("aria-haspopup") == "listbox"
        listed = ids.get(a.get("aria-controls") or a.get("list", "\0"))
        options = [n.text() or n.attrs.get("value", "") for n in listed.walk() if n.tag == "option" or n.attrs.get("role") == "option"][:OPTIONS] if combo and listed else []
        out.append(
            {
                "index": len(out), "dom_pos": node.order, "tag": tag, "role": "iframe" if frame else role, "text": _label(node, ids, labels, labelled), "placeholder": a.get("placeholder", ""), "href": link, "raw_href": a.get("href"),
                "handle": str(node.order), "disabled": "disabled" in a or a.get("aria-disabled") == "true", "required": "required" in a or a.get("aria-required") == "true",
                "checked": ("checked" in a or a.get("aria-checked") == "true") if kind in ("checkbox", "radio") or role in ("checkbox", "radio", "switch") else None,
                "selected": a["aria-selected"] == "true" if "aria-selected" in a else None, "value": value[:VALUE_CHARS] if value is not None else None,
                "is_combobox": combo, "combobox_expanded": a.get("aria-expanded") == "true" if combo else None, "combobox_options": options, "expanded": a.get("aria-expanded"),
                "focusable": "tabindex" in a and a["tabindex"] != "-1", "onclick": "onclick" in a, "has_data": any(k.startswith("data-") for k in a), "has_class": bool(a.get("class")), "frame_host": host,
            }
        )
    return out


def read_pages(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """pages (page_id, url, html) to page_id, url, title, page_text, blocks and elements, in one pass, and the columns in keep.

    A null page has no title, text, blocks or elements. Long pages weigh on a few tasks, so rows go in small batches.
    """
    kinds = dict(pages.dtypes)
    more = "".join(f", {c} {kinds[c]}" for c in keep)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 64):
                rows = []
                for row in part.iloc[at : at + 64].itertuples(index=False):
                    root = parse(row.html)
                    title = next((n.text() for n in root.walk() if n.tag == "title"), "")
                    rows.append((row.page_id, row.url, title, page_text_of(root), blocks_of(root), elements_of(root, row.url or "")))
                out = pd.DataFrame(rows, columns=["page_id", "url", "title", "page_text", "blocks", "elements"])
                yield out.assign(**{c: part[c].iloc[at : at + 64].to_numpy() for c in keep})

    return pages.select("page_id", "url", "html", *keep).mapInPandas(run, f"page_id {kinds['page_id']}, url string, title string, page_text string, blocks {BLOCKS}, elements {ELEMENTS}{more}")


def blocks(read: DataFrame) -> DataFrame:
    return read.select("page_id", "url", "title", F.inline("blocks"))


def elements(read: DataFrame) -> DataFrame:
    return read.select("page_id", "url", F.inline("elements"))


def links(els: DataFrame) -> DataFrame:
    """Text and absolute http(s) address of links that lead elsewhere."""
    away = ~F.coalesce("raw_href", F.lit("")).rlike(r"^\s*(#|mailto:|javascript:|tel:)") & F.col("href").rlike("(?i)^https?://")
    return els.where((F.col("tag") == "a") & F.col("href").isNotNull() & away).select("page_id", "text", "href")


def frames(els: DataFrame, trackers: tuple[str, ...] = TRACKERS) -> DataFrame:
    """Iframes whose host holds no tracker's name."""
    listed = els.sparkSession.createDataFrame([(t,) for t in trackers], "tracker string")
    found = els.where("tag = 'iframe'").alias("e")
    return found.join(F.broadcast(listed), F.contains(F.coalesce("frame_host", F.lit("")), F.col("tracker")), "left_anti")


def click_candidates(els: DataFrame, first: int = 150, keep: int = 40) -> DataFrame:
    """Per page the elements most like something to click, by score, ties in page order."""
    short = F.length("text").between(1, 60)
    score = 3 * F.col("onclick").cast("int") + 2 * F.col("focusable").cast("int") + 2 * F.col("has_data").cast("int") + F.col("has_class").cast("int") + short.cast("int")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "dom_pos"))
    return els.withColumn("score", score).withColumn("place", place).where(F.col("place") <= min(first, keep))


def reveal_controls(els: DataFrame) -> DataFrame:
    """Per page the first control with a phrase of revealing that stays on the page, else the first collapsed one."""
    says = F.lit(False)
    for phrase in REVEAL_PHRASES:
        says = says | F.contains(F.lower("text"), F.lit(phrase))
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "#.*$", "")
    stays = (F.col("tag") != "a") | F.coalesce("raw_href", F.lit("")).rlike("^(#|$)") | (bare("href") == bare("url"))
    kind = F.when((F.col("tag").isin("a", "button") | (F.col("role") == "button")) & says & stays, 0).when(F.col("expanded") == "false", 1)
    rows = els.withColumn("kind", kind).where("kind is not null")
    return rows.groupBy("page_id").agg(F.min_by(F.struct("dom_pos", "tag", "text", "kind"), F.struct("kind", "dom_pos")).alias("c")).select("page_id", "c.*")


def consent_buttons(els: DataFrame) -> DataFrame:
    """P10: per page the first button whose whole label accepts cookies."""
    button = (F.col("tag") == "button") | (F.col("role") == "button")
    rows = els.where(button & F.lower(F.trim("text")).isin(*CONSENT_LABELS))
    return rows.groupBy("page_id").agg(F.min_by(F.struct("dom_pos", "text"), "dom_pos").alias("c")).select("page_id", "c.*")


def frame_urls(html: Column) -> Column:
    """Iframe addresses in a page's source."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("""(?i)<iframe[^>]+src\\s*=\\s*["']?([^"' >]+)"""), 1)


def flat_frames(edges: DataFrame, deepest: int = 100) -> DataFrame:
    """page_id, frame_id, url and depth of every frame of a frame tree (page_id, frame_id, parent_id, url), from the
    frames without a parent down, by one recursive query: each level is joined once.

    A tree deeper than deepest, or one that runs in a circle, fails the job.
    """
    spark = edges.sparkSession
    edges.createOrReplaceTempView("_frame_edges")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(deepest))
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(
        """WITH RECURSIVE tree AS (
            SELECT page_id, frame_id, url, 0 AS depth FROM _frame_edges WHERE parent_id IS NULL
            UNION ALL SELECT e.page_id, e.frame_id, e.url, t.depth + 1 FROM tree t JOIN _frame_edges e ON e.page_id = t.page_id AND e.parent_id = t.frame_id)
        SELECT page_id, frame_id, url, depth FROM tree"""
    )


def blockable(url: Column) -> Column:
    """Whether an address is an image, a font or media."""
    return F.coalesce(url, F.lit("")).rlike(rf"(?i)\.({'|'.join(HEAVY_FILES)})$")


def saved(requests: DataFrame) -> DataFrame:
    """Per page the share of requests and bytes that blocking saves. requests: page_id, url, bytes."""
    block = blockable(F.col("url"))
    return requests.groupBy("page_id").agg(F.avg(block.cast("int")).alias("requests_saved"), (F.sum(F.when(block, F.col("bytes")).otherwise(0)) / F.sum("bytes")).alias("bytes_saved"))
