"""Main text of web pages with site style trees (operator 2).

The pages of a host are merged into one style tree: a node is a path of tags with their classes,
and holds over all pages how its children are arranged (presentation) and what text it contains
(content). A node's importance comes from the entropies of both: a branch that looks and reads the
same on every page of a site says little, one whose text differs from page to page is content. Low
branches are removed from each page. Elements that HTML itself names as something else than the
article (menus, footers, forms, scripts, asides, or boxes whose class says advert, comment, notice
and the like; inside an article only those whose name is just that) go whatever the site's size; boxes inside an article or main element are judged
by entropy too, but only where the articles around them differ (pages of one main text count as one
page of the tree, and near copies don't count as differing), so an article that many pages copy
stays; its paragraphs and headings are never judged, and are no part of its wrappers' content.

Defined results: null or empty html has no text; broken markup is read as far as it goes, unclosed
elements end with their parent, and those nested deeper than ``DEEPEST`` count as neighbours; a page without any text gives the empty string; repeated rows each
give their row; pages without a host form a site of their own; extra columns pass through.
"""

from __future__ import annotations

import html as entities
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from seriesforge.llm.common import written

#: Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg canvas select textarea button".split())
NOT_MAIN = frozenset("head nav footer aside form dialog menu".split()) | RAW
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SELF_CLOSING = {"p": BLOCKS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
HIDDEN_ROLE = regex.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|nav\w*|menu|breadcrumbs?|sidebar|side|widget|header|masthead|footer|comments?|disqus|respond|reply|notices?|cookies?|consent|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|social|related|recommend\w*|pagination|pager|toolbar|skip|copyright|legal|disclaimer)(?:$|[\s_-])",
    regex.I,
)
JUDGED = frozenset("div section ul ol dl table details fieldset ins".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
BOXES = (BLOCKS - HEADINGS - {"html", "body", "article", "main", "header"}) | {"ins"}
#: Inside the article a box goes if one of its names is just that of an advert, a comment, a notice, a form, a
#: sidebar or a menu, alone or with words that only say what kind or which part of it.
BOX_ROLE = regex.compile(
    r"(?:(?:site|page|user|reader|post|cookies?|privacy|contact|mail|signup|newsletter|left|right|top|bottom|main|sub|google)[_-])*"
    r"(?:ads?|adsbygoogle|advert\w*|comments?|notices?|forms?|sidebars?|menus?|nav|navbar|navigation)"
    r"(?:[_-](?:box|block|area|section|container|wrap|wrapper|inner|slot|unit|list|items?|thread|form|widget|bar|left|right|top|bottom|\d+))*",
    regex.I,
)
TOKEN = regex.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|([^<]+|<)", regex.S)
#: Elements whose content is raw text: no tag or comment opens in it, only their own end tag counts.
RAW_END = {tag: regex.compile(rf"</{tag}(?![^\s/>])[^>]*>?", regex.I) for tag in ("script", "style", "textarea", "iframe")}
ATTRIBUTE = regex.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", regex.I)
#: Elements nested deeper are read as if they stood beside each other; their text stays.
DEEPEST = 200
HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)"

MIN_PAGES = 4
LOW = 0.3
DEPTH_SHARE = 0.9
#: A box inside the article is judged where this share of its pages have differing articles around it.
APART = 0.5


class Node:
    """An element: path key, whether it lies in the article, parts (texts, or children), and
    whether an article lies in it."""

    __slots__ = ("tag", "key", "main", "gone", "parts", "block", "holds")

    def __init__(self, tag: str, key: int, main: bool, gone: bool):
        self.tag, self.key, self.main, self.gone, self.parts, self.block = tag, key, main, gone, [], tag in BLOCKS
        self.holds = False


def tokens(page: str) -> Iterator[regex.Match]:
    """The tags, comments and texts of a page; after the tag of a raw element those that follow its end."""
    at = 0
    while at < len(page):
        for m in TOKEN.finditer(page, at):
            yield m
            end = RAW_END.get(m[2].lower()) if m[2] and not m[1] else None
            if end:
                close = end.search(page, m.end())
                at = close.end() if close else len(page)
                break
        else:
            return


def parsed(page: str | None) -> Node:
    """The element tree of a page."""
    root = Node("", 0, False, False)
    stack = [root]
    flat: Counter[str] = Counter()  # open elements that are too deep for the stack
    for m in tokens(page or ""):
        close, tag, attributes, text = m.groups()
        if text is not None:
            stack[-1].parts.append(text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if close:
            if flat[tag]:
                flat[tag] -= 1
                if tag in BLOCKS:  # an empty block, where the line ends
                    stack[-1].parts.append(Node(tag, stack[-1].key, stack[-1].main, False))
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        if tag in RAW_END:
            continue
        if tag in VOID:
            stack[-1].parts.append(" " if tag in ("br", "hr") else "")
            continue
        if tag in BLOCKS or tag in SELF_CLOSING:  # a block ends an open paragraph, an item the one before
            for depth in range(len(stack) - 1, 0, -1):
                open_ = stack[depth].tag
                if tag in SELF_CLOSING.get(open_, ()):
                    del stack[depth:]
                    break
                if open_ in BLOCKS and open_ != "p":
                    break
        own, role = "", ""
        if attributes and ("class" in attributes or "id" in attributes or "role" in attributes or "CLASS" in attributes):
            for name, a, b, c in ATTRIBUTE.findall(attributes):
                role += f" {a or b or c}"
                if name.lower() == "class":
                    own = a or b or c
        up = stack[-1]
        key = xxhash.xxh64_intdigest(f"{up.key}>{tag}.{own}") >> 1
        main = up.main or tag in ("article", "main")
        if not role or tag in HEADINGS or tag in ("html", "body", "article", "main"):
            named = False
        elif up.main:
            named = tag in BOXES and any(BOX_ROLE.fullmatch(name) for name in role.split())
        else:
            named = HIDDEN_ROLE.search(role) is not None
        gone = tag in NOT_MAIN or (tag == "header" and not up.main) or named
        node = Node(tag, key, main, gone)
        if tag in ("article", "main") and not gone:
            for above in stack:
                above.holds = True
        up.parts.append(node)
        if attributes.endswith("/") and any(n.tag == "math" for n in stack):
            continue  # elsewhere HTML takes no notice of the slash
        if len(stack) > DEEPEST and (stack[-1].gone or not gone):
            flat[tag] += 1
        else:
            stack.append(node)
    return root


def style(node: Node, found: dict[int, tuple]) -> str:
    """Gathers a page's part of the style tree: for each block path outside the article that HTML
    doesn't rule out, its arrangement and its text. Returns the node's text outside the article."""
    texts, tags = [], []
    for p in node.parts:
        if isinstance(p, str):
            texts.append(p)
        else:
            tags.append(p.tag)
            texts.append("" if p.gone or p.main else style(p, found))
    text = " ".join(" ".join(texts).split())
    if node.block and not node.holds and node.tag not in ("html", "body"):
        before = found.get(node.key, ((), "", None))
        found[node.key] = (before[0] + tuple(tags), before[1] + "\n" + text, None)
    return text


def inner(root: Node, found: dict[int, tuple]) -> None:
    """Gathers the boxes inside the article in the same way, each with what tells its page from
    others: the least hash of five words in the longest text that the article has outside the box,
    which near copies of an article share. A box that holds the whole article is not judged."""
    leaves: list[str] = []
    boxes: dict[int, tuple] = {}

    def walk(node: Node):
        first = len(leaves)
        for p in node.parts:
            if isinstance(p, str):
                if node.main and not p.isspace() and p:
                    leaves.append(p)
            elif not p.gone:
                walk(p)
        if node.main and node.tag in JUDGED and not node.holds and len(leaves) > first:
            look = tuple(p.tag for p in node.parts if not isinstance(p, str))
            text = " ".join(" ".join(leaves[first:]).split())
            before = boxes.get(node.key, ((), "", first, 0))
            boxes[node.key] = (before[0] + look, before[1] + "\n" + text, before[2], len(leaves))

    walk(root)
    if not boxes:
        return
    longest = sorted(range(len(leaves)), key=lambda k: -len(leaves[k]))
    known: dict[int, int] = {}
    for key, (look, text, a, b) in boxes.items():
        rest = next((k for k in longest if not a <= k < b), None)
        if rest is None:
            continue
        if rest not in known:
            w = leaves[rest].split()
            known[rest] = min(xxhash.xxh64_intdigest(" ".join(w[k : k + 5])) for k in range(max(len(w) - 4, 1))) >> 1
        found[key] = (look, text, known[rest])


def main_text(root: Node, low: set[int]) -> str:
    """The page's text without removed branches, a line for each block."""
    lines: list[str] = []
    run: list[str] = []

    def end():
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                lines.append(text)
            run.clear()

    def walk(node: Node, inside: bool):
        if node.gone or (node.key in low and not node.holds):
            return
        if node.block:
            end()
        for p in node.parts:
            if isinstance(p, str):
                if inside or node.main or not only_main:
                    run.append(p)
            else:
                walk(p, inside or p.main)
        if node.block:
            end()

    only_main = has_main(root)
    walk(root, False)
    end()
    return "\n".join(lines)


def has_main(node: Node) -> bool:
    """Whether the page marks its article."""
    return any(not isinstance(p, str) and not p.gone and (p.main or has_main(p)) for p in node.parts)


def low_branches(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(host, keys): the paths of each host's style tree whose importance is low."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, pages_, keys, looks, texts, others = [], [], [], [], [], []
            for host, page in zip(batch.column(0), batch.column(1)):
                found: dict[int, tuple] = {}
                root = parsed(page.as_py())
                style(root, found)
                inner(root, found)
                own = xxhash.xxh64_intdigest(main_text(root, set())) >> 1
                for key, (look, text, other) in found.items():
                    hosts.append(host.as_py())
                    pages_.append(own)
                    keys.append(key)
                    looks.append(xxhash.xxh64_intdigest(",".join(look)) >> 1)
                    texts.append(xxhash.xxh64_intdigest(text) >> 1)
                    others.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(c, pa.int64()) for c in (pages_, keys, looks, texts, others))], ["host", "page", "key", "look", "text", "other"])

    found = pages.select(F.regexp_extract(F.lower(url), HOST, 1).alias("host"), html).mapInArrow(gathered, "host string, page long, key long, look long, text long, other long")
    # Pages of one text (copies) are one page of the tree.
    found = found.groupBy("host", "key", "page").agg(F.min("look").alias("look"), F.min("text").alias("text"), F.min("other").alias("other"))
    # One aggregation for each kind of feature: only counts are shuffled, hot sites included.
    feature = lambda kind, name: F.struct(F.lit(kind).alias("kind"), F.col(name).alias("value"))
    kinds = found.select("host", "key", F.explode(F.array(feature(0, "look"), feature(1, "text"), feature(2, "other"))).alias("f")).where("f.value IS NOT NULL")
    counts = kinds.groupBy("host", "key", "f.kind", "f.value").agg(F.count("*").alias("n"))
    spread = counts.groupBy("host", "key", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"), F.count("*").alias("d"))
    entropy = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0)
    weight = F.when(F.col("kind") == 0, 1 - DEPTH_SHARE).when(F.col("kind") == 1, DEPTH_SHARE).otherwise(0.0)
    alone = F.max(F.when(F.col("kind") == 2, F.col("d") / F.col("m")))
    value = spread.groupBy("host", "key").agg(F.max("m").alias("pages"), F.sum(weight * entropy).alias("importance"), F.coalesce(alone, F.lit(1.0)).alias("alone"))
    low = value.where((F.col("pages") >= MIN_PAGES) & (F.col("importance") < LOW) & (F.col("alone") >= APART))
    return low.groupBy("host").agg(F.collect_list("key").alias("__low"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with ``text``, the main text. Low branches of a site reach its pages by a join on
    the host, whose small side is a written table of known size."""
    rules = written(low_branches(pages, url, html).withColumnRenamed("host", "__host"), "branches")

    @F.arrow_udf(T.StringType())
    def read(html: pa.Array, low: pa.Array) -> pa.Array:
        return pa.array([main_text(parsed(h.as_py()), set(k.as_py() or ())) for h, k in zip(html, low)], pa.string())

    both = pages.withColumn("__site", F.regexp_extract(F.coalesce(F.lower(url), F.lit("")), HOST, 1)).join(rules, F.col("__site") == F.col("__host"), "left")
    made = both.withColumn("__text", read(F.col(html), F.col("__low")))
    return made.select(*[F.col(f"`{c}`") for c in pages.columns if c != text], F.col("__text").alias(text))


def op2_html_extract(spark, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
