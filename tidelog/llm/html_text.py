"""Operator 7: main-text extraction with site style trees.

Each page is read once into blocks: runs of text between block-level tags, each with the node of the
element it stands in, which is the hash of the names of all elements down to it. The pages of one host are
merged into a style tree of these nodes, and a block's importance is entropy-based. For m
distinct pages with a host, a content that k of them share at a node is worth
1 - log k / log (m + 3): 1 if no page shares it, near 0 if all of many do; the 3 are pages
not seen, so that few pages prove little. A container's presentation (its sequence of child tags) is
weighed alike, and the two are joined as (1 - g**l) * presentation + g**l * content, for l
presentations (3 at most) and g = 0.9. What a page says of itself is a prior that this is
multiplied by: PRIOR where an element around the block is named as a notice, advert, comments or the like
by a whole token of its class, id or role; inside an article or main element the content's worth counts
least / sure times. Blocks whose importance is below ``least`` are removed. Pages with one headline (or,
without one, one text) count once, so copies of a page don't make its text look like a template.

Some elements never hold text: menus, footers, sidebars, forms, buttons, scripts, styles, headers outside
an article, hidden elements, and inline elements named as above. If a page has articles or main
elements, its text is there, but for smaller parts that are mostly links; else it is all important blocks that are
not mostly links.

References are decoded, white space within a block becomes one space, blocks are joined by
line feeds in page order. A null or empty page has an empty text. Cut-off markup is closed
at the end of the page. Pages of unknown host form no tree. Repeated rows are extracted each and count
once. A very long page is read in one pass, in time linear in its length. Of a page's largest parts all that tie
count. The ``keep`` columns may have any names but ``text`` and ``n_chars``, which are those of the result.
"""

from __future__ import annotations

import html as _html
import re
import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .text import by_slice

# HTML element names by role, and words in class, id and role attributes.
RAW = "script|style|noscript|template|textarea|iframe|svg|math|object|select|title|xmp|noframes"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
OFF_TAGS = frozenset("nav footer aside form head button menu dialog label input".split())
OFF_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising advertorial banner sponsor sponsored sponsors promo promotion promoted cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login signin register sidebar side rail menu menubar nav navbar navigation navigational breadcrumb breadcrumbs toolbar footer masthead topbar comment comments commentlist reply replies respond disqus discussion share sharing social related recommended recommendations widget widgets search pagination pager skip toc contentinfo complementary hidden".split()
)
ON_WORDS = frozenset("main".split())
TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\b[^>]*>|\Z)|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-z][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.I | re.S,
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDE = re.compile(r"(?<![\w-])hidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_QUOTED = re.compile(r"\b(?:class|id|title|alt|data-[\w-]+)\s*=\s*(?:\"[^\"]*\"|'[^']*')", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSES_P = BLOCKS - frozenset("option legend summary body html head".split())
_TWINS = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "li": ("li",), "tr": ("tr",), "option": ("option",)}
#: First words of tokens that tell of an element inside, or of a state, not of what the element is.
_ABOUT = frozenset("has with no is show hide without".split())
PRIOR = 0.2
UNSEEN = 3


def _named_off(token: str, article: bool) -> bool:
    """Whether a token of a class, id or role names a notice, advert or the like: all its parts do, or the last one
    (post-sidebar). An article is named so by all parts only."""
    parts = [w.lower() for w in _PARTS.findall(token)]
    if not parts or parts[-1] not in OFF_WORDS:
        return False
    return all(w in OFF_WORDS for w in parts) or not (article or parts[0] in _ABOUT)


def _traits(tag: str, attrs: str) -> tuple[str, bool, bool, bool]:
    """An element's name in the tree, whether it never holds text, whether it is named off, and whether it is a main part."""
    dead, off, on, name = tag in OFF_TAGS, False, tag in ("article", "main"), tag
    if attrs and ("=" in attrs or "hidden" in attrs.lower()):
        whole = tag in ("html", "body")
        for kind, a, b, c in _NAMES.findall(attrs):
            value = a or b or c
            tokens = value.split()
            off = off or (not whole and any(_named_off(t, on) for t in tokens))
            on = on or any(t.lower() in ON_WORDS for t in tokens)
            if kind.lower() == "class":
                name = f"{tag}.{value}"
        dead = dead or bool(_HIDE.search(_QUOTED.sub("", attrs)))
    return name, dead, off, on


class Block:
    __slots__ = ("text", "node", "parent", "tag", "part", "linked", "off")

    def __init__(self, text, node, parent, tag, part, linked, off):
        self.text, self.node, self.parent, self.tag, self.part, self.linked, self.off = text, node, parent, tag, part, linked, off


class _Open:
    """An open element; a block-level one counts the inline elements open directly within it."""

    __slots__ = ("tag", "node", "dead", "off", "part", "inline")

    def __init__(self, tag, node, dead, off, part, inline):
        self.tag, self.node, self.dead, self.off, self.part, self.inline = tag, node, dead, off, part, inline


def _below(node: int, name: str) -> int:
    """The number of the node with a name below another, 63 bits."""
    x = (node ^ zlib.crc32(name.encode("utf-8", "surrogatepass"))) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    return (x ^ x >> 29) * 0xBF58476D1CE4E5B9 >> 1 & (1 << 63) - 1


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order. ``part`` numbers the article or main element around it, -1 outside. Every
    element is opened and closed once and looked up by counts, so the time is linear in the page."""
    stack = [_Open("", 0, False, False, -1, {})]
    levels = [0]  # places of the block-level elements in the stack
    opened: dict[str, int] = {}
    out: list[Block] = []
    text: list[str] = []
    linked = links = parts = at = 0

    def flush():
        nonlocal linked
        if text:
            words = " ".join(_html.unescape("".join(text)).split())
            if words:
                own, above = stack[levels[-1]], stack[levels[-2] if len(levels) > 1 else 0]
                out.append(Block(words, own.node, above.node, own.tag, own.part, min(1.0, linked / max(1, len(words))), own.off))
            text.clear()
        linked = 0

    def close(tag: str):
        """Closes elements up to the innermost open one with the tag."""
        while True:
            e = stack.pop()
            if e.inline is None:
                stack[levels[-1]].inline[e.tag] -= 1
            else:
                levels.pop()
                opened[e.tag] -= 1
            if e.tag == tag:
                return

    for m in TAG.finditer(page):
        if m.start() > at and not stack[-1].dead:
            piece = page[at : m.start()]
            text.append(piece)
            if links:
                linked += len(piece)
        at = m.end()
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        block = tag in BLOCKS
        if m["end"]:
            if tag == "a":
                links = 0
            if block and opened.get(tag):
                flush()
                close(tag)
            # An inline end tag doesn't close a block around its element.
            elif not block and stack[levels[-1]].inline.get(tag):
                close(tag)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                text.append(" ")
            continue
        if tag == "a":
            links = 1
        if block:
            flush()
            links = 0
            if stack[levels[-1]].tag == "p" and tag in _CLOSES_P:
                close("p")
            if stack[levels[-1]].tag in _TWINS.get(tag, ()):
                close(stack[levels[-1]].tag)
        elif m["attrs"].rstrip().endswith("/"):
            continue
        name, dead, off, on = _traits(tag, m["attrs"])
        top = stack[-1]
        dead = dead or top.dead or (tag == "header" and top.part < 0) or (off and not block)
        part = top.part
        if on and not (dead or off or top.off) and (part < 0 or tag in ("article", "main")):
            part, parts = parts, parts + 1
        if block:
            levels.append(len(stack))
            opened[tag] = opened.get(tag, 0) + 1
        else:
            inline = stack[levels[-1]].inline
            inline[tag] = inline.get(tag, 0) + 1
        stack.append(_Open(tag, _below(top.node, name), dead, off or top.off, part, {} if block else None))
    if at < len(page) and not stack[-1].dead:
        text.append(page[at:])
    flush()
    return out


def importance(block, whole: float = 1.0, own: float = 1.0, least: float = 0.3, sure: float = 0.05) -> float:
    """A block's importance from that of its content and presentation (``whole``), its content's alone, and its prior."""
    return (PRIOR if block.off else 1.0) * (whole if block.part < 0 else min(1.0, own * least / sure))


def choose(found: list[Block], worth: dict[int, tuple[float, float]] | None = None, least: float = 0.3, sure: float = 0.05) -> list[str]:
    """The texts of a page's main part; ``worth`` has (whole, own) of blocks by their places, 1 where it has none."""
    one, worth = (1.0, 1.0), worth or {}
    kept = [b for i, b in enumerate(found) if importance(b, *worth.get(i, one), least, sure) >= least]
    size: dict[int, int] = {}
    linked: dict[int, float] = {}
    for b in found:
        if b.part >= 0 and not b.off:
            size[b.part] = size.get(b.part, 0) + len(b.text)
            linked[b.part] = linked.get(b.part, 0) + b.linked * len(b.text)
    if size:
        most = max(size.values())
        parts = {p for p, n in size.items() if n == most or 2 * linked[p] <= n}
        return [b.text for b in kept if b.part in parts]
    return [b.text for b in kept if b.linked <= 0.5]


def _hash(text: str) -> int:
    data = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(data) << 31 ^ zlib.adler32(data)


BLOCK = "struct<text:string,node:long,parent:long,tag:string,part:int,linked:double,off:boolean,content:long>"
_FIELDS = [("text", pa.string()), ("node", pa.int64()), ("parent", pa.int64()), ("tag", pa.string()), ("part", pa.int32()), ("linked", pa.float64()), ("off", pa.bool_()), ("content", pa.int64())]


def _parse(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Each page's blocks, and a number that pages of one headline share."""
    keys, ends, cols = [], [0], {k: [] for k, _ in _FIELDS}
    for page in batch.column("html").to_pylist():
        found = blocks(page or "")
        head = next((b.text for b in found if b.tag == "h1" and not b.off), None)
        keys.append(_hash(head if head is not None else "\n".join(b.text for b in found)))
        for b in found:
            for k, v in cols.items():
                v.append(_hash(b.text) if k == "content" else getattr(b, k))
        ends.append(len(cols["text"]))
    items = pa.StructArray.from_arrays([pa.array(cols[k], t) for k, t in _FIELDS], names=[k for k, _ in _FIELDS])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)
    return pa.record_batch([*(batch.column(c) for c in batch.schema.names if c != "html"), pa.array(keys, pa.int64()), lists], names=[*(c for c in batch.schema.names if c != "html"), "page", "blocks"])


def style_tree(pages: DataFrame, least: float = 0.3, sure: float = 0.05, decay: float = 0.9) -> DataFrame:
    """host, node, content, whole, own of the contents of low importance; ``pages`` has host, page and blocks."""
    known = pages.filter("host != ''")
    flat = known.select("host", "page", F.explode("blocks").alias("b"))
    text = flat.select("host", "page", F.lit(0).alias("kind"), "b.node", "b.parent", "b.content")
    # A container's presentation: the tags of its blocks in page order.
    shapes = known.select("host", "page", F.explode(F.array_distinct(F.transform("blocks", lambda b: b["parent"]))).alias("parent"), "blocks")
    shape = F.xxhash64(F.array_join(F.transform(F.filter("blocks", lambda b: b["parent"] == F.col("parent")), lambda b: b["tag"]), " "))
    shapes = shapes.select("host", "page", F.lit(1).alias("kind"), F.col("parent").alias("node"), "parent", shape.alias("content"))
    once = text.union(shapes).distinct()
    shared_by = once.groupBy("host", "kind", "node", "parent", "content").agg(F.count(F.lit(1)).alias("k"))
    shared_by = shared.settle(shared_by.filter("k > 1 or kind = 1"), "contents")
    pages_of = shared.settle(known.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("m")), "hosts")
    worth = shared_by.join(pages_of, "host").withColumn("own", 1 - F.log("k") / F.log(F.col("m") + UNSEEN))
    shape = worth.filter("kind = 1").groupBy("host", "parent").agg((F.sum(F.col("k") * F.col("own")) / F.sum("k")).alias("shape"), F.count(F.lit(1)).alias("l"))
    text = worth.filter("kind = 0").join(shape, ["host", "parent"], "left")
    weight = F.pow(F.lit(decay), F.least(F.coalesce("l", F.lit(0)), F.lit(3)))
    whole = (1 - weight) * F.coalesce("shape", F.lit(0)) + weight * F.col("own")
    return text.select("host", "node", "content", whole.alias("whole"), "own").filter((F.col("whole") < least) | (F.col("own") < sure))


def extract(pages: DataFrame, keep: list[str], html: str = "html", url: str = "url", least: float = 0.3, sure: float = 0.05) -> DataFrame:
    """The ``keep`` columns of each page, text and n_chars."""
    with shared.scratch(pages.sparkSession) as hold:
        out = shared.settle(_extracted(pages, keep, html, url, least, sure), "text")
        hold(out)
    return out


def _extracted(pages: DataFrame, keep: list[str], html: str, url: str, least: float, sure: float) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    # The columns to keep go by number, so that their names can't clash.
    own = {f"k{i}": c for i, c in enumerate(keep)}
    rows = pages.select(*(F.col(c).alias(k) for k, c in own.items()), F.col(html).alias("html"), host.alias("host"), F.xxhash64(F.col(url), F.col(html)).alias("row"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "html")
    read = shared.settle(rows.mapInArrow(by_slice("html", _parse), f"{kinds}, page long, blocks array<{BLOCK}>"), "blocks")
    low = shared.settle(style_tree(read, least, sure), "low")
    # A host may have a third of all pages, and each of them its template: its contents meet them in parts.
    salts = 16
    salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    at = read.filter("host != ''").select("host", "row", F.pmod("row", F.lit(salts)).cast("int").alias("salt"), F.posexplode("blocks").alias("place", "b")).select("host", "row", "salt", "place", "b.node", "b.content")
    hit = at.join(salted, ["host", "salt", "node", "content"]).groupBy("row", "place").agg(F.first(F.struct("whole", "own")).alias("w"))
    hit = hit.groupBy("row").agg(F.collect_list(F.struct("place", "w.whole", "w.own")).alias("low"))  # as many as a page has blocks
    marked = read.join(shared.settle(hit, "hits"), "row", "left").select(*own, "blocks", "low")
    fields = [k for k, _ in _FIELDS if k != "content"]

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for found, marks in zip(batch.column("blocks").to_pylist(), batch.column("low").to_pylist(), strict=True):
            found = [Block(*(b[k] for k in fields)) for b in found]
            out.append("\n".join(choose(found, {x["place"]: (x["whole"], x["own"]) for x in marks or []}, least, sure)))
        text = pa.array(out, pa.string())
        return pa.record_batch([*(batch.column(c) for c in own), text, pc.utf8_length(text).cast(pa.int64())], names=[*own, "text", "n_chars"])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                yield make(batch.slice(start, 256))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in marked.select(*own).schema)
    out = marked.mapInArrow(run, f"{kinds}{', ' if own else ''}text string, n_chars long")
    return out.select(*(F.col(k).alias(c) for k, c in own.items()), "text", "n_chars")
