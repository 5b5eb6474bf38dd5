"""Main text of web pages by site template removal.

Every page is parsed into the subtrees of its block-level elements.  Each subtree is
hashed, bottom up and before any rule about classes or elements, and the pages that hold
it are counted per host in Spark.  A subtree recurs if it stands on ``min_pages`` pages of
its host.  What recurs may also be an article's own passage that other articles quote, so
recurrence is read by slot, the path of elements (with class and id, digits left out) from
the page's root: a recurring subtree is deleted as template if at least ``min_share`` of
all that stands in its slot on that host recurs.  Menus and footers meet that even when a
site rotates dozens of them; paragraphs of articles do not.  The slot that holds most
distinct text of a host is its content and never template, nor are html, body, main and
article.  A page made of nothing but template is a copy of another and keeps its text.

What is left for rules: sections that HTML itself or their class, id or role marks as
menu, header, footer, sidebar, notice, advert, form or reader comments go as well, as a
host of few pages shows no recurrence.  ``n_template_blocks`` and ``n_rule_blocks`` say
how many blocks of text went by counting, and how many by rules alone.

Scale: two scans of ``pages``; (host, subtree) counts are partially aggregated, written
once, and are the only exchange, so a host with a third of all pages costs no more than
any other.  The hashes to delete are broadcast if counted below BROADCAST_ROWS; beyond
that they are joined by host, hosts of many pages split by salts.  Parsing is linear in
the length of a page, whatever its nesting.

Defined results: null html or html without text gives '' and 0; a null url is a host of
its own; repeated page_ids are rows like any other; an empty table gives no row; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import html as _html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, texts_of, tune

#: Pages of a host that one salt of the shuffled join takes.
SALT_PAGES = 20_000

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[a-zA-Z/!?][^>]*>?)", re.S)
#: The same without regard to quotes, for the rest of a page after a quote that never ends.
_BARE = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[a-zA-Z/!?][^>]*>?)", re.S)
#: Elements whose content is no markup.
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style textarea title xmp iframe noembed noframes".split()}
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_MAIN = re.compile(r"\brole\s*=\s*[\"']?(?:main|article)\b", re.I)
_COMMENT = re.compile(r"\b(?:class|id)\s*=\s*[\"']?[^\"'>]*\bcomment", re.I)
_TELLING = re.compile(r"\b(?:class|id|role|style|hidden)\b|aria-hidden", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

# Element names of HTML.
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset("head nav footer aside form menu noscript template svg canvas object button select dialog audio video search".split())
_ROOT = frozenset("html body article main".split())
#: What an opening tag closes, up to the given ancestors.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "body": (("head",), ("html",)),
}
#: Words in a class, id or role that mark a section as no part of the article.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner sidebar sidebars rail nav navbar "
    "navigation menu menus breadcrumb breadcrumbs header masthead topbar footer colophon notice notices alert cookie cookies consent gdpr popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments respond "
    "discussion disqus replies widget widgets toolbar pagination pager search contentinfo complementary".split()
)
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile("[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _marked(attrs: str, within_article: bool) -> bool:
    for _, a, b, c in _ATTR.findall(attrs):
        words = _WORD.findall(_CAMEL.sub(" ", a or b or c).lower())
        hit = _MARKS.intersection(words)
        if within_article:
            hit -= {"header", "banner"}
        if hit:
            return True
    return False


class Node:
    """An element: ``key`` is the hash of its subtree, ``slot`` of its path, ``size`` its own text's length."""

    __slots__ = ("attrs", "drop", "gone", "holds", "key", "main", "parent", "parts", "size", "slot", "tag")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts, self.size, self.key = [], 0, 0
        self.drop, self.gone, self.holds, self.main = False, False, False, False
        names = " ".join(sorted(_DIGITS.sub("", (a or b or c).lower()) for _, a, b, c in _ATTR.findall(attrs))) if attrs else ""
        self.slot = _hash(f"{parent.slot if parent else 0} {tag} {names}")


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


class _Open:
    """The stack of open elements; finding one by name takes constant time."""

    def __init__(self):
        self.root = Node("#root", "", None)
        self.stack, self.at, self.blocks = [self.root], {}, []

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in _BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def last(self, tags) -> int:
        """The depth of the innermost open element of ``tags``, or 0."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def block(self) -> int:
        return self.blocks[-1] if self.blocks else 0

    def cut(self, depth: int) -> None:
        """Closes everything from ``depth`` on, each hash into its parent's."""
        while len(self.stack) > depth:
            node = self.stack.pop()
            node.key = _hash("\n".join((node.tag, *node.parts)))
            node.parts = ()
            if node.parent is None:
                break
            node.parent.parts.append(f"<{node.key}>")
            self.at[node.tag].pop()
            if node.tag in _BLOCK:
                self.blocks.pop()


def _folded(text: str) -> str:
    return " ".join((_html.unescape(text) if "&" in text else text).split())


Chunks = list[tuple[str, Node]]


def parse(page: str) -> tuple[list[Node], list[Chunks]]:
    """(elements in page order, the root first; blocks of text as chunks with the innermost element)."""
    opened, blocks, held, inline = _Open(), [], [], set()
    stack, nodes = opened.stack, [opened.root]

    def flush():
        if held:
            text = _folded("".join([t for t, _ in held]))
            if text:
                node = stack[opened.block()]
                node.parts.append(text)
                node.size += len(text)
                blocks.append(held.copy())
            held.clear()

    at, pattern = 0, _TAG
    while m := pattern.search(page, at):
        start, stop = m.span()
        if start > at:
            held.append((page[at:start], stack[-1]))
        at = stop
        closing, tag, attrs = m.groups()
        if not tag:
            if page[start + 1 : start + 2].isalpha():  # a quote without an end
                pattern = _BARE
            continue
        tag = tag.lower()
        if tag in _RAW:
            if not closing:
                over = _RAW[tag].search(page, stop)
                at = over.end() if over else len(page)
            continue
        block = tag in _BLOCK
        if closing:
            if block:
                flush()
            elif tag not in inline:
                continue
            depth = opened.last((tag,))
            if depth and (block or depth > opened.block()):
                opened.cut(depth)
            continue
        if block:
            flush()
            if tag not in _ROOT or tag in ("article", "main"):
                depth = opened.block()  # an open paragraph ends where a block begins
                if depth and stack[depth].tag == "p":
                    opened.cut(depth)
            if tag in _CLOSES:
                closed, limit = _CLOSES[tag]
                floor = opened.last(limit)
                if tag == "tr":
                    found = [d for t in closed if (held_at := opened.at.get(t)) for d in held_at[bisect.bisect_right(held_at, floor) :][:1]]
                    if found:
                        opened.cut(min(found))
                elif (depth := opened.last(closed)) > floor:
                    opened.cut(depth)
        if tag == "br":
            held.append((" ", stack[-1]))
        if tag in _VOID:
            continue
        if not block:
            if attrs.rstrip().endswith("/"):
                continue
            if tag not in _DROP and not (attrs and _TELLING.search(attrs)):
                continue  # an inline element that nothing can drop needs no node
            inline.add(tag)
        node = Node(tag, attrs, stack[-1])
        nodes.append(node)
        opened.push(node)
    held.append((page[at:], stack[-1]))
    flush()
    opened.cut(0)
    return nodes, blocks


def by_rules(nodes: list[Node]) -> None:
    """Marks what elements, classes, ids and roles tell to be no part of an article (``drop``)."""
    for node in nodes[1:]:  # parents come before children
        up = node.parent
        node.main = up.main
        if node.tag in ("article", "main") or (node.attrs and _MAIN.search(node.attrs)):
            if not up.drop and not _COMMENT.search(node.attrs):
                node.main = True
                while up is not None and not up.holds:
                    up.holds = True
                    up = up.parent
    for node in nodes[1:]:
        if node.parent.drop:
            node.drop = True
        elif node.tag in _DROP or (node.tag == "header" and not node.parent.main):
            node.drop = not node.holds
        elif node.attrs and node.tag not in ("html", "body"):
            node.drop = not node.holds and (_marked(node.attrs, node.parent.main) or bool(_HIDDEN.search(node.attrs)))
    articles = any(x.main and not x.drop for x in nodes)
    for node in nodes:
        node.drop = node.drop or (articles and not node.main)


def _able(node: Node) -> bool:
    """Whether a subtree may be template."""
    return node.tag in _BLOCK and node.tag not in _ROOT


def _key(host: int, node: Node) -> int:
    return ((node.key ^ host) & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def extract(page: str, host: int, listed: frozenset[int]) -> tuple[str, int, int]:
    """(text, blocks that went as template, blocks that went by rules alone) of a page."""
    nodes, blocks = parse(page)
    by_rules(nodes)
    if listed:
        for node in nodes[1:]:
            node.gone = node.parent.gone or (_able(node) and not node.holds and _key(host, node) in listed)
    if not any(not node.gone and not node.drop for chunks in blocks for _, node in chunks):
        for node in nodes:  # nothing would be left: a copy
            node.gone = False
    kept, template, ruled = [], 0, 0
    for chunks in blocks:
        text = _folded("".join([t for t, node in chunks if not node.gone and not node.drop]))
        if text:
            kept.append(text)
        elif all(node.gone for t, node in chunks if t.strip()):
            template += 1
        else:
            ruled += 1
    return "\n\n".join(kept), template, ruled


def _subtrees(batches):
    kinds = {"host": pa.int64(), "key": pa.int64(), "slot": pa.int64(), "size": pa.int64()}
    for batch in batches:
        out = []
        for host, page in zip(batch.column("host").to_pylist(), texts_of(batch, "html"), strict=True):
            found = {_key(host, n): (n.slot - (1 << 63), n.size) for n in parse(page)[0] if _able(n)}
            out.extend((host, key, *rest) for key, rest in found.items())
        cols = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], names=list(kinds))


def _extracted(batches):
    names = ["page_id", "url", "text", "n_chars", "n_template_blocks", "n_rule_blocks"]
    for batch in batches:
        found, known = [], {}
        for host, page, listed in zip(batch.column("host").to_pylist(), texts_of(batch, "html"), batch.column("template"), strict=True):
            if host not in known:
                known[host] = frozenset(listed.as_py() or ())
            found.append(extract(page, host, known[host]))
        text, template, ruled = zip(*found, strict=True) if found else ((), (), ())
        cols = [pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), pa.array(template, pa.int64()), pa.array(ruled, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *cols], names=names)


def templates(rows: DataFrame, scratch: Scratch, min_pages: int, min_share: float) -> DataFrame:
    """(host, key) of the subtrees to delete from ``rows`` (host, html)."""
    found = rows.select("host", "html").mapInArrow(_subtrees, "host long, key long, slot long, size long")
    counts = scratch.table(found.groupBy("host", "key", "slot").agg(F.count(F.lit(1)).alias("pages"), F.max("size").alias("size")))
    recurs = F.col("pages") >= min_pages
    slots = counts.groupBy("host", "slot").agg(F.sum("pages").alias("all"), F.sum(F.when(recurs, F.col("pages")).otherwise(0)).alias("again"), F.sum("size").alias("size"))
    content = slots.groupBy("host").agg(F.max_by("slot", F.struct("size", "slot")).alias("content"))
    able = slots.where(F.col("again") >= F.lit(float(min_share)) * F.col("all")).where("again > 0").join(content, "host").where("slot <> content").select("host", "slot")
    return scratch.table(counts.where(recurs).join(able, ["host", "slot"], "left_semi").select("host", "key"))


def extract_main_text(pages: DataFrame, min_pages: int = 3, min_share: float = 0.8) -> DataFrame:
    """(page_id, url, text, n_chars, n_template_blocks, n_rule_blocks) of each row of ``pages`` (page_id, url, html).

    A subtree recurs if it stands on at least ``min_pages`` pages of its host, and is
    template if at least ``min_share`` of what fills its slot on that host recurs.
    """
    spark = pages.sparkSession
    tune(spark)
    scratch = Scratch(spark)
    name = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.xxhash64(name).alias("host"))
    listed = templates(rows, scratch, min_pages, min_share)
    scratch.keep_only(listed)
    number, per_host = listed.count(), listed.groupBy("host").agg(F.collect_set("key").alias("template"))
    if number <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(per_host), "host", "left")
    else:  # the hosts of over SALT_PAGES pages are few, at most rows / SALT_PAGES
        hot = rows.groupBy("host").count().where(F.col("count") > SALT_PAGES).select("host", F.ceil(F.col("count") / SALT_PAGES).cast("int").alias("salts"))
        hot = F.broadcast(scratch.table(hot))
        salts = F.coalesce("salts", F.lit(1))
        dealt = rows.join(hot, "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), salts).cast("int")).drop("salts")
        spread = per_host.join(hot, "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        joined = dealt.join(spread, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "host", "template").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long, n_template_blocks long, n_rule_blocks long")
