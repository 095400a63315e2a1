"""Main text of web pages by site template removal.

Every page is parsed once, in a task, into its element tree.  The content roots
are all ``main`` and ``article`` elements (else the body); elements whose tag,
role or style marks them (navigation, footers, asides, forms, scripts, hidden
parts) or whose class or id is the very name of such a part (``comments``,
``site-header``, ``ad``) are left out, also on a host of one page.  All other
subtrees below the roots may belong to the site's template: their hashes (tag,
class, texts and child hashes) are counted per host in Spark, and a subtree that
occurs on many pages of its host is deleted.  Words inside a class or id
(``related-work``) are hints: such an element is counted by its mark, too, and
goes if the mark recurs on the host, whatever it holds.  A hinted element that is
the host's only one stays.

A group of copied pages does not make its article a template: a subtree counts
once per different main text, not once per page.  Paragraphs of an article,
passages that several articles share among them, are content unless they stand in
most of the host's different texts: their blocks are counted on every page, too.

A host may hold any share of the pages: counting is a distinct and a partial
aggregation.  Decisions return to a page as the list of its own template
subtrees, which the page bounds; only pages with open subtrees travel for that.
"""

from __future__ import annotations

import html as _html
import re
import string

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .inputs import pick

# HTML element classes.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noscript noframes noembed template xmp svg math".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp "
                    "small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
                      "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_SIBLINGS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
             "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select datalist")}
_SIBLINGS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _SIBLINGS.items()}
_HEAD = frozenset(["head"])
_PARAGRAPH_ENDS = (frozenset(["p"]), frozenset(["table", "td", "th", "button"]))
_PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre table figure figcaption dl dt dd ul ol tr td th tbody thead "
                       "tfoot caption hr address".split())

# Marks of boilerplate.  Words of _OFF_WORDS and _HEADER_WORDS are hints that
# must recur; a class or id that is a name as it stands needs no count.
_OFF_TAGS = frozenset("nav footer aside form button select menu dialog object canvas audio video".split())
_OFF_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense ad-banner ad-box ad-container ad-slot ad-unit "
                   "ad-wrapper comments comment-list comment-section comments-area comments-section reader-comments "
                   "disqus_thread cookie-banner cookie-bar cookie-consent cookie-notice cookies sidebar side-bar "
                   "newsletter newsletter-signup share-buttons social-share".split())
_SITE_NAMES = frozenset("header masthead page-header site-header topbar footer page-footer site-footer menu main-menu "
                        "site-menu nav navbar navigation site-nav breadcrumb breadcrumbs".split())
_OFF_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie "
                       "cookies consent gdpr notice popup modal overlay newsletter subscribe signup share sharing social "
                       "comment comments reply replies disqus sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
                       "related recommended widget pagination pager skip toolbar".split())
_HEADER_WORDS = frozenset("header masthead topbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]++)\s*+(?:=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
_SPLIT = re.compile(r"[^a-z0-9]+")


#: usual blocks of all hosts that are broadcast; more of them meet the pages in a shuffle
BROADCAST_BLOCKS = 100_000


class Node:
    __slots__ = ("tag", "attrs", "children", "off", "digest", "hint", "article")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children, self.off, self.digest, self.hint, self.article = tag, attrs, [], False, None, None, False


class _Open:
    """The open elements, and where those of each tag stand: no step walks the stack."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def nearest(self, tags: frozenset) -> int:
        """Place of the innermost open element of ``tags``, 0 without one."""
        return max((at[-1] for at in map(self.places.get, tags) if at), default=0)

    def close(self, tags: frozenset, limits: frozenset = frozenset()) -> None:
        """Close the innermost of ``tags`` unless one of ``limits`` is further in."""
        at = self.nearest(tags)
        if at and at > self.nearest(limits):
            while len(self.stack) > at:
                self.places[self.stack.pop().tag].pop()


def _attributes(raw: str) -> dict:
    if "=" not in raw and "hidden" not in raw:
        return {}
    out = {}
    for name, value in _ATTR.findall(raw):
        name = name.lower()
        if name in ("class", "id", "role", "hidden", "aria-hidden", "style", "itemprop"):
            out.setdefault(name, _html.unescape(value.strip("\"'")).lower())
    return out


def parse(page: str) -> Node:
    """Element tree of a page; unclosed, stray and cut-off tags are tolerated.
    Raw-text elements keep no content; text is decoded."""
    root = Node("#root", {})
    opened, at, lower = _Open(root), 0, None
    stack = opened.stack
    for m in iter(lambda: _TOKEN.search(page, at), None):
        if m.start() > at:
            stack[-1].children.append(_html.unescape(page[at:m.start()]))
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag, close, raw = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if close:
            if tag == "br":
                stack[-1].children.append(" ")
            opened.close((tag,))
            continue
        if tag in _CLOSES_P:
            opened.close(*_PARAGRAPH_ENDS)
        elif tag in _SIBLINGS:
            opened.close(*_SIBLINGS[tag])
        if tag == "body":
            opened.close(_HEAD)
        if tag == "br":
            stack[-1].children.append(" ")
        if tag in _VOID:
            if tag == "hr":
                stack[-1].children.append(Node("hr", {}))
            continue
        node = Node(tag, _attributes(raw))
        stack[-1].children.append(node)
        if raw.rstrip().endswith("/") and tag in _RAW:
            continue
        if tag in _RAW:
            if lower is None:
                lower = page.translate(_ASCII_LOWER)
            end = lower.find("</" + tag, at)
            if end < 0:
                at = len(page)
            else:
                end = page.find(">", end)
                at = len(page) if end < 0 else end + 1
            continue
        opened.push(node)
    if at < len(page):
        stack[-1].children.append(_html.unescape(page[at:]))
    return root


_ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def _marked(node: Node, in_article: bool) -> bool:
    """Whether tag, role, style or name mark the node as boilerplate."""
    if node.tag in _OFF_TAGS or node.tag in _RAW or node.tag == "head":
        return True
    if node.tag == "header" and not in_article:
        return True
    a = node.attrs
    if not a:
        return False
    if a.get("role") in _OFF_ROLES or "hidden" in a or a.get("aria-hidden") == "true":
        return True
    if "style" in a and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a["style"]):
        return True
    names = {*a.get("class", "").split(), a.get("id")}
    return not names.isdisjoint(_NAMES if in_article else _NAMES | _SITE_NAMES)


def _words(attrs: dict) -> set:
    return set(_SPLIT.split(f"{attrs.get('class', '')} {attrs.get('id', '')}"))


def _hint(node: Node, in_article: bool) -> int | None:
    """Hash of tag, class and id if their words hint at boilerplate."""
    a = node.attrs
    if not a or not _words(a) & (_OFF_WORDS if in_article else _OFF_WORDS | _HEADER_WORDS):
        return None
    return xxhash.xxh3_64_intdigest(f"hint {node.tag} {a.get('class', '')} {a.get('id', '')}")


def _walk(root: Node):
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]


def _find_articles(root: Node) -> None:
    """Set ``article`` of all nodes that hold an article or main element below them."""
    for node in reversed(list(_walk(root))):
        node.article = any(c.article or c.tag in ("article", "main") for c in node.children if isinstance(c, Node))


def mark(root: Node) -> list[Node]:
    """Content roots in page order; boilerplate below them is marked ``off`` or
    gets a ``hint``.  Outside an article, a marked node that holds one is kept for
    its sake."""
    found, body = [], root
    _find_articles(root)
    todo = [(root, False, False)]
    while todo:
        node, in_article, in_root = todo.pop()
        if node.tag == "body":
            body = node
        elif node.tag not in ("#root", "html"):
            if _marked(node, in_article) and (in_article or not node.article):
                node.off = True
                continue
            node.hint = _hint(node, in_article)
        if node.tag in ("article", "main") or node.attrs.get("role") == "main":
            if not in_root:
                found.append(node)
            in_article, in_root = in_article or node.tag == "article", True
        todo += [(c, in_article, in_root) for c in reversed(node.children) if isinstance(c, Node)]
    return found or [body]


def _digest(node: Node) -> int:
    """Merkle hash of a subtree, children first without recursion."""
    for n in reversed(list(_walk(node))):
        h = xxhash.xxh3_64(f"<{n.tag} {n.attrs.get('class', '')} {n.attrs.get('id', '')}>")
        for c in n.children:
            h.update(" ".join(c.split()) if isinstance(c, str) else b"\0" + c.digest.to_bytes(8, "little"))
        n.digest = h.intdigest()
    return node.digest


def open_subtrees(roots: list[Node]) -> list[Node]:
    """Subtrees that structure does not settle, below the roots."""
    out = []
    for root in roots:
        todo = [(c, root.tag == "article", False) for c in root.children if isinstance(c, Node)]
        while todo:
            node, in_article, settled = todo.pop()
            in_article = in_article or node.tag == "article"
            if node.off or node.tag in _INLINE and node.hint is None:
                continue
            settled = settled or in_article and node.tag in _PARAGRAPH
            if not settled or node.hint is not None:
                out.append(node)
            todo += [(c, in_article, settled) for c in node.children if isinstance(c, Node)]
    return out


def blocks_text(roots: list[Node]) -> str:
    """Blocks in page order, white space collapsed, joined by newlines."""
    blocks, current = [], []

    def flush():
        text = " ".join("".join(current).split())
        if text:
            blocks.append(text)
        current.clear()

    for root in roots:
        todo = [root]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                current.append(x)
            elif not x.off:
                inline = x.tag in _INLINE
                if not inline:
                    flush()
                    todo.append(None)
                todo += reversed(x.children)
        flush()
    return "\n".join(blocks)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _read(page: str | None, template: set[int] | None = None):
    """(text, open subtree hashes); with ``template``, its subtrees are deleted."""
    if not page:
        return "", []
    roots = mark(parse(page))
    nodes = open_subtrees(roots)
    for node in nodes:
        if node.digest is None:
            _digest(node)
        if template and any(_signed(h) in template for h in (node.digest, node.hint) if h is not None):
            node.off = True
    return blocks_text(roots), sorted({_signed(h) for n in nodes for h in (n.digest, n.hint) if h is not None})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            min_pages: int = 3, min_share: float = 0.02, enough: int = 20, most: float = 0.5) -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars``.

    A subtree (or the mark of an element) is a template if it occurs with at least
    ``min_pages`` different main texts of its host and with ``min_share`` of the
    host's different main texts, or with ``enough`` of them on a host of any size.  A
    block of any kind goes if it stands in ``enough`` different main texts of the
    host and in more than the share ``most`` of them.  If
    nothing but templates would remain, the result is empty text.  Null and
    empty pages give empty text; a null or malformed URL belongs to the host ''.
    Repeated rows give repeated results.  An empty table gives an empty result.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col).withColumn("host", host)
    id_type = rows.schema["page_id"].dataType.simpleString()

    def read(batches):
        for batch in batches:
            texts, nodes, kept = [], [], []
            for page in batch.column(2).to_pylist():
                text, found = _read(page)
                texts.append(text)
                nodes.append(found)
                kept.append(page if found else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(texts, pa.string()),
                 pa.array(nodes, pa.list_(pa.int64())), pa.array(kept, pa.string())],
                names=["page_id", "url", "host", "text", "nodes", "html"])

    parsed = cut_lineage(rows.mapInArrow(
        read, f"page_id {id_type}, url string, host string, text string, nodes array<long>, html string"), "pages")
    settled = parsed.filter("html is null").select("page_id", "url", "host", "text")
    if not parsed.filter("html is not null").isEmpty():
        settled = settled.union(_without_templates(parsed, id_type, min_pages, min_share, enough))
    return _without_usual_blocks(settled, parsed, enough, most).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _without_usual_blocks(texts: DataFrame, parsed: DataFrame, enough: int, most: float) -> DataFrame:
    """``texts`` without the blocks that most of their host's different main texts hold."""
    mains = parsed.select("host", F.xxhash64("text").alias("main")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("mains"))
    blocks = parsed.filter("text != ''").select(
        "host", F.xxhash64("text").alias("main"), F.explode(F.transform(F.split("text", "\n"), lambda b: F.xxhash64(b))).alias("block"))
    usual = blocks.distinct().groupBy("host", "block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= enough)
    usual = cut_lineage(usual.join(mains, "host").filter(F.col("n") > F.col("mains") * most)
                        .groupBy("host").agg(F.collect_list("block").alias("usual")), "usual-blocks")
    n = usual.select(F.coalesce(F.sum(F.size("usual")), F.lit(0))).first()[0]
    if not n:
        return texts
    usual = F.broadcast(usual) if n <= BROADCAST_BLOCKS else usual
    rest = F.filter(F.split("text", "\n"), lambda b: ~F.array_contains("usual", F.xxhash64(b)))
    return texts.join(usual, "host", "left").withColumn(
        "text", F.when(F.col("usual").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n")))


def _without_templates(parsed: DataFrame, id_type: str, min_pages: int, min_share: float, enough: int) -> DataFrame:
    """Text of the pages with open subtrees, after counting those per host."""
    unsettled = parsed.filter("html is not null").withColumn("page_key", F.xxhash64("html"))
    seen = unsettled.select("host", F.xxhash64("text").alias("main"), F.explode("nodes").alias("node")).distinct()
    mains = parsed.select("host", F.xxhash64("text").alias("main")).distinct()
    sizes = mains.groupBy("host").agg(F.count(F.lit(1)).alias("mains"))
    often = seen.groupBy("host", "node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    templates = often.join(sizes, "host").filter(
        F.col("n") >= F.least(F.col("mains") * min_share, F.lit(enough))).select("host", "node")
    of_page = (unsettled.select("host", "page_key", F.explode("nodes").alias("node")).distinct()
               .join(templates, ["host", "node"]).groupBy("host", "page_key").agg(F.collect_list("node").alias("template")))

    def delete(batches):
        for batch in batches:
            texts = [_read(page, set(template))[0] if template else text for text, page, template in
                     zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())],
                                             names=["page_id", "url", "host", "text"])

    joined = unsettled.join(of_page, ["host", "page_key"], "left").select("page_id", "url", "host", "text", "html", "template")
    return joined.mapInArrow(delete, f"page_id {id_type}, url string, host string, text string")
