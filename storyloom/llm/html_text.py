"""Main text of web pages by site style trees.

The pages of a host merge into one tree, whose nodes are paths of elements with their class and id (their presentation).
A node's importance is the entropy, over the pages that have it, of the styles of its children and of its content: what
looks and reads alike on all pages is boilerplate. It is drawn towards a prior where few pages tell, so there is no least
number of pages. What an element is for in the markup weighs the importance: up within article and main, down for menus,
footers, forms and the like. A branch whose weighted importance stays under LOW goes, with all text in it.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, session, slices, small

LOW = 0.3  # weighted importance below which a branch goes
PRIOR = 1.5  # pages that the prior counts for
PRESENTATION = 0.2  # weight of the children's styles; content has the rest
BROADCAST_NODES = 200_000
HOSTS = 64  # trees that a task keeps
LOOK_BACK = 256  # open elements that are searched for one that a new element closes by its nature

# Kinds of elements, and for each the weight of its importance and the prior by where it is: within main content, beside
# a page's main content, on a page without any. What the markup names as a menu, footer, advert, ... goes everywhere.
PLAIN, WEAK, FORM, SURE = range(4)
WITHIN, BESIDE, ALONE = range(3)
WEIGHT = ((1.5, 0.5, 1.0), (0.6, 0.1, 0.45), (0.15, 0.1, 0.45), (0.15, 0.1, 0.15))
EXPECTED = ((1.0, 0.3, 1.0), (1.0, 0.3, 0.5), (0.5, 0.3, 0.5), (0.5, 0.3, 0.5))

# HTML elements by what they are for.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template svg math iframe textarea title".split())
DROPPED = RAW | set("head object canvas audio video button select input".split())
MENUS = set("nav footer aside menu dialog".split())
FORMS = set("form label fieldset".split())
BLOCKS = set("address article aside blockquote body caption center dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul dialog menu fieldset".split())
LEAVES = set("p h1 h2 h3 h4 h5 h6 dd dt blockquote pre figcaption caption summary".split())
MAIN = {"article", "main"}
# Words of class, id and role values: of elements that are not main text, and of ones that may be.
ADVERTS = set("ad ads advert adverts advertisement advertising sponsored".split())
ROLES = ADVERTS | set("breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr header login masthead menu menubar nav navbar navigation newsletter notice notices pager pagination respond replies sidebar signup subscribe toolbar".split())
HINTS = set("alert banner dialog disclaimer feedback modal notification overlay popup promo promoted promotion recommended related reply search share sharing social sponsor widget".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_DIGITS = re.compile(r"[0-9]+")
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


@dataclass(slots=True)
class Element:
    tag: str
    parent: int  # place of the element around it, -1 of the page
    key: bytes  # of its path
    kind: int
    main: bool  # main content, or in it
    other: bool  # not plain, or in an element that isn't
    dropped: bool
    node: bool  # whether it is a branch of the tree
    branch: int  # the nearest branch: itself or one around it, or -1
    holds: bool = False  # main content starts in it
    styles: list = field(default_factory=list)
    content: list = field(default_factory=list)  # digests of texts, and places of the branches in it


def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"\0".join(parts), digest_size=8).digest()


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


def tokens(page: str):
    """("text", string), ("start", tag, attributes), ("end", tag) and ("raw", tag) for the parts of a page, in time linear in
    its length.

    Comments, declarations and the insides of RAW elements are left out. A tag whose quotes never close ends at the next
    >; one that never ends stops before the next <.
    """
    at, n, last, strict = 0, len(page), page.rfind(">"), True
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:]
            return
        if lt > at:
            yield "text", page[at:lt]
        following = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if following in ("!", "?") or following == "/" and not page[lt + 2 : lt + 3].isalpha():
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _NAME.match(page, lt)
        if not m:
            yield "text", "<"
            at = lt + 1
            continue
        whole = _TAG.match(page, lt) if strict else None
        if whole:
            closing, tag, attributes, at = whole[1], whole[2].lower(), whole[3], whole.end()
        else:
            strict = False
            gt = page.find(">", m.end()) if last >= m.end() else -1
            if gt < 0:
                end = page.find("<", m.end())
                at = n if end < 0 else end
                continue
            closing, tag, attributes, at = m[1], m[2].lower(), page[m.end() : gt], gt + 1
        if closing:
            yield "end", tag
        elif tag in RAW and not (attributes.endswith("/") and tag in ("svg", "math")):
            end = _ENDS[tag].search(page, at)
            at = end.end() if end else n
            yield "raw", tag
        else:
            yield "start", tag, attributes


def _kind(tag: str, named: dict[str, str], in_main: bool) -> int:
    words = set(" ".join(named.get(k, "") for k in ("class", "id", "role")).lower().split()) if named else set()
    if tag in MENUS:
        return SURE
    if tag in FORMS or (tag == "header" and not in_main):
        return FORM
    if tag in ("html", "body", "article", "main") or not words:
        return PLAIN
    if tag in BLOCKS:
        return WEAK if tag in LEAVES and words & ROLES or words & HINTS and not words & ROLES else SURE if words & ROLES else PLAIN
    return SURE if words & ADVERTS else PLAIN


def read(page: str) -> tuple[list[tuple[str, int]], list[Element]]:
    """The blocks (text, place of the element) of a page and its elements, each after the one around it."""
    elements = [Element("", -1, b"", PLAIN, False, False, False, False, -1)]
    stack, scope = [0], [-1]  # places of open elements; place in the stack of the p that a new block closes
    open_: dict[str, int] = {}
    blocks: list[tuple[str, int]] = []
    text: list[str] = []

    def flush():
        if not text:
            return
        words = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        top = elements[stack[-1]]
        if words and not top.dropped:
            blocks.append((words, stack[-1]))
            if top.branch >= 0:
                elements[top.branch].content.append(_digest(words.encode("utf-8", "replace")))

    def cut(i: int):
        """Close the open elements from place i of the stack on."""
        if any(elements[e].tag in BLOCKS for e in stack[i:]):
            flush()
        for e in stack[i:]:
            open_[elements[e].tag] -= 1
        del stack[i:], scope[i:]

    def close(tags, stop):
        if any(open_.get(t) for t in tags):
            for i in range(len(stack) - 1, max(0, len(stack) - 1 - LOOK_BACK), -1):
                tag = elements[stack[i]].tag
                if tag in tags:
                    return cut(i)
                if tag in stop:
                    return None

    for part in tokens(page):
        if part[0] == "text":
            text.append(part[1])
            continue
        tag = part[1]
        if part[0] == "end":
            if tag == "p":
                flush()
            elif tag == "br":
                text.append(" ")
            if open_.get(tag):
                cut(next(i for i in range(len(stack) - 1, 0, -1) if elements[stack[i]].tag == tag))
            continue
        if part[0] == "raw":
            if tag in ("textarea", "title", "iframe"):
                flush()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                text.append(" ")
            continue
        block = tag in BLOCKS
        if block:
            flush()
            if scope[-1] >= 0:
                cut(scope[-1])
            if tag == "li":
                close(("li",), ("ul", "ol", "menu"))
            elif tag in ("dd", "dt"):
                close(("dd", "dt"), ("dl",))
            elif tag in ("td", "th"):
                close(("td", "th"), ("table", "tr"))
            elif tag == "tr":
                close(("tr",), ("table",))
        attributes = part[2]
        if attributes.endswith("/") and not block:
            continue
        named: dict[str, str] = {}
        for k, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
            named.setdefault(k.lower(), a or b or c)
        # An id's digits tell pages apart, not styles.
        values = " ".join(f"{k}={_DIGITS.sub('#', v) if k == 'id' else v}" for k, v in named.items() if k in ("class", "id", "role"))
        place, up = len(elements), elements[stack[-1]]
        starts = tag in MAIN or "main" in named.get("role", "").lower().split()
        kind = _kind(tag, named, up.main)
        hidden = "hidden" in named or bool(_UNSHOWN.search(named.get("style", "")))
        # Elements without a branch have no importance: their kind decides.
        dropped = up.dropped or tag in DROPPED or hidden or (kind >= FORM and not block)
        node = block and not dropped and tag not in ("html", "body")
        style = f"{tag}[{values}]".encode("utf-8", "replace")
        e = Element(tag, stack[-1], _digest(up.key, style) if block else up.key, kind, up.main or starts, up.other or kind != PLAIN, dropped, node, place if node else up.branch)
        if up.branch >= 0:
            elements[up.branch].styles.append(style)
            if node:
                elements[up.branch].content.append(place)
        if starts and not (dropped or up.other):
            above = stack[-1]
            while above >= 0 and not elements[above].holds:
                elements[above].holds = True
                above = elements[above].parent
        elements.append(e)
        stack.append(place)
        scope.append(len(stack) - 1 if tag == "p" else -1 if tag in ("table", "td", "th", "button") else scope[-1])
        open_[tag] = open_.get(tag, 0) + 1
    flush()
    return blocks, elements


def branches(page: str):
    """(path, digest of its children's styles, digest of its content) for each path of branches of a page."""
    _, elements = read(page)
    content: dict[int, bytes] = {}
    for place in range(len(elements) - 1, 0, -1):  # what is in an element comes after it
        e = elements[place]
        if e.node:
            parts = [content[x] if isinstance(x, int) else x for x in e.content]
            content[place] = _digest(*parts) if any(parts) else b""
    paths: dict[bytes, tuple[list, list]] = {}
    for place, e in enumerate(elements):
        if e.node:
            styles, texts = paths.setdefault(e.key, ([], []))
            styles.append(_digest(*e.styles))
            texts.append(content[place])
    for key, (styles, texts) in paths.items():
        yield _number(key), _number(_digest(*styles)), _number(_digest(*texts))


def main_text(page: str | None, known) -> str:
    """The blocks of a page that stay, given (pages, entropy) by path for its host's branches, as a dict or pairs."""
    blocks, elements = read(page or "")
    known = known if isinstance(known, dict) else dict(known)
    parted = any(elements[e].main and not elements[e].other for _, e in blocks)
    holders = {e.key for e in elements if e.holds}
    stays = [True] * len(elements)
    for place, e in enumerate(elements[1:], 1):
        stays[place] = stays[e.parent]
        if e.node and stays[place]:
            where = ALONE if e.key in holders else WITHIN if e.main else BESIDE if parted else ALONE
            pages, entropy = known.get(_number(e.key), (1, 0.0))
            importance = ((pages - 1) * entropy + PRIOR * EXPECTED[e.kind][where]) / (pages - 1 + PRIOR)
            stays[place] = importance * WEIGHT[e.kind][where] >= LOW
    # Text beside the main content stays only in a branch of its own.
    own = [False] * len(elements)
    for place, e in enumerate(elements[1:], 1):
        own[place] = own[e.parent] or (e.node and e.key not in holders)
    return "\n\n".join(text for text, e in blocks if stays[e] and (not parted or elements[e].main or own[e]))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, pages, entropy) for each node of each host, from rows (host, html)."""

    def run(it):
        for batch in slices(it):
            rows = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(host, *b) for b in branches(page or "")]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["host", "node", "style", "content"])

    seen = pages.select("host", "html").mapInArrow(run, "host string, node long, style long, content long")
    # Counts by (node, kind, value): partial sums first, so that a hot host costs no more than its distinct values.
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("style").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("content").alias("value"))))
    counts = seen.select("host", "node", kinds.alias("k")).groupBy("host", "node", "k.kind", "k.value").agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy("host", "node", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    # -sum(n/m log_m(n/m)) = 1 - sum(n ln n) / (m ln m)
    entropy = F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * F.ln("m"))).otherwise(0.0)
    weight = F.when(F.col("kind") == 0, PRESENTATION).otherwise(1 - PRESENTATION)
    return sums.groupBy("host", "node").agg(F.max("m").alias("pages"), F.sum(entropy * weight).alias("entropy"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages.

    text has the blocks that stay, in page order, joined by two line ends; within a block character references are
    decoded and white space is one blank. A block stays where the importance of each branch around it, weighted by what
    the branch is for, reaches LOW. A null or empty html, and a page without main text, give an empty text. Pages without
    a host in their url (null among them) share one tree. Repeated rows each count. Other columns are ignored. An empty
    table gives an empty result. A page of any length or nesting is read in time linear in its length.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    # A branch of a single page has no entropy: its prior holds, without a row.
    known = style_tree(rows).filter("pages > 1")
    known = materialise(known.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("node", "pages", "entropy"))).alias("known")), "styles")
    nodes = known.agg(F.sum(F.size("known"))).first()[0] or 0
    if nodes <= BROADCAST_NODES and small(known, BROADCAST_NODES):
        known = F.broadcast(known)

    def run(it):
        trees: dict[str, dict] = {}
        for batch in slices(it):
            texts = []
            for i, (name, page) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if name not in trees:
                    if len(trees) == HOSTS:
                        trees.clear()
                    trees[name] = {e["node"]: (e["pages"], e["entropy"]) for e in batch.column(4)[i].as_py() or ()}
                texts.append(main_text(page, trees[name]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = rows.join(known, "host", "left").select("page_id", "url", "host", "html", "known")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
