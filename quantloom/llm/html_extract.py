"""Main text of web pages with a site style tree.

The pages of a host are merged into one tree. Its element nodes carry how many pages have them and
in how many presentation styles (sequences of children); its content nodes carry how often each text
occurs. A branch whose presentation and content are the same on most pages has a low entropy-based
importance and is removed from each page; so is what the page itself declares to be no content
(menus, footers, adverts, forms ...). Where a page declares an article, only text inside it is kept,
without the low branches in it.

The tree is kept as rows (host, path, feature, count), so a host of any size is only summed; copies
of a page count once. Each page is parsed in the task that reads it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import staged

#: Weight of a node's own presentation against its content and children, and what counts as low.
GAMMA, LOW, LEAST_PAGES = 0.9, 0.25, 4
#: A block's text is low on its own if it stands on so large a part of the pages that have its node.
MOST = 0.5

# Names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template svg xmp noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
DROPPED = set(
    "head script style noscript template iframe svg nav header footer aside form button select textarea "
    "input dialog menu object canvas audio video title".split()
)
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
MARKS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav "
    "navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notices popup modal overlay "
    "newsletter subscribe signup share sharing social related recommended widget comment comments disqus replies respond "
    "pagination pager toc toolbar login".split()
)
# Words that may stand beside a mark in a name of several words: what the element is, or where.
BESIDE = set(
    "area article articles bar bars block body bottom box btn button buttons card cell col column container content form "
    "google group icon icons inline inner item items label large left line link links list main mobile panel posts primary right row "
    "secondary section side slot small space stories sticky strip text title top unit wrap wrapper zone c l js".split()
)
# Marks that may also come last in such a name, behind words that only say where; the others come first.
LAST = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar breadcrumb breadcrumbs cookie "
    "cookies consent popup newsletter subscribe signup share sharing related recommended comments disqus pagination pager".split()
)
BEFORE = set("article bottom c google inline item js l large left mobile primary right side small sticky text top".split())
# What a text's own parts are: only a class that is a mark as a whole speaks against them, no id.
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre figcaption caption span b i em strong a".split())
#: Beyond so many levels a path ends in a hash of the rest.
DEEP = 64
CLOSES_P = BLOCK - {"html", "body"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# After "<": a comment, a declaration, an end or a start tag. Each ends at the first ">" but for start
# tags, whose quoted values may hold some.
COMMENT, TAG = re.compile(r"!--.*?(?:-->|\Z)", re.S), re.compile(r"[!?]|(/?)([a-zA-Z][^\s/>]*)")
VALUES = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


class Node:
    """``dropped``: by the tag or role, ``marked``: by a mark or as a form, which holds only where no
    declared content stands below; after parsing ``dropped`` has what is left of both and of the parents.
    ``holds``: a declared article or main element stands at or below the node and is not dropped."""

    __slots__ = ("dropped", "holds", "kids", "main", "marked", "path", "tag")

    def __init__(self, tag: str, path: str, dropped: bool, marked: bool, main: bool):
        self.tag, self.path, self.dropped, self.marked, self.main, self.holds, self.kids = tag, path, dropped, marked, main, False, []


def attributes(source: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(source)}


def marked_name(name: str, textual: bool = False) -> bool:
    """Whether a class or id marks its element: as a whole; or, if the element is no part of a text, as a
    mark with words that say no more than what or where it is."""
    if name in MARKS or textual:
        return name in MARKS
    words = [w for w in re.split(r"[-_]+", name) if w]
    if not words:
        return False
    first = words[0] in MARKS and all(w in MARKS or w in BESIDE or w.isdigit() for w in words)
    return first or words[-1] in LAST and all(w in BEFORE for w in words[:-1])


def opened(tag: str, source: str, parent: Node) -> Node:
    name, dropped, marked = tag, tag in DROPPED and tag != "form", tag == "form"
    if source.strip(" /"):
        have = attributes(source)
        classes = have.get("class", "").split()
        if classes:
            name = f"{tag}.{classes[0]}"
        role, textual = have.get("role", "").lower(), tag in TEXTUAL
        named = [c.lower() for c in (classes if textual else [*classes, *have.get("id", "").split()])]
        if tag == "article":
            dropped |= bool({"comment", "comments"} & {w for c in named for w in (c, re.split("[-_]", c)[0])})
        elif tag not in ("html", "body", "main"):
            marked |= any(marked_name(c, textual) for c in named)
        marked |= role == "form"
        dropped |= role in ROLES - {"form"} or "hidden" in have
    return Node(tag, below(parent.path, name), dropped, marked, parent.main or tag in ("article", "main"))


def below(path: str, name: str) -> str:
    """The path of a child; its length is bounded, however deep the page nests."""
    if path.count(">") < DEEP:
        return f"{path}>{name}"
    head, _, rest = path.partition(">~")
    return f"{head}>~{xxhash.xxh64_hexdigest(f'{rest}>{name}')}"


def settle(root: Node) -> None:
    """Sets ``holds`` and ``dropped``. A marked node or form stays if declared content stands below it
    that is not itself in an article (there it is a comment, by the rules of HTML), or if it is a form
    with all text of the body."""
    nodes = list(walk(root))
    for node in reversed(nodes):  # what stands below comes first
        node.holds = not node.dropped and (node.tag in ("article", "main") or any(k.holds for k in node.kids if isinstance(k, Node)))
    todo, bodies = [(root, False, False)], 0
    while todo:
        node, dropped, article = todo.pop()
        node.dropped |= dropped or node.marked and (article or not node.holds)
        bodies += node.tag == "body"
        if node.tag == "body" and bodies == 1:
            rest = [k for k in node.kids if (k.strip() if isinstance(k, str) else k.tag == "form" or not k.dropped and not k.marked and any(isinstance(t, str) and t.strip() for x in walk(k) for t in x.kids))]
            if len(rest) == 1 and isinstance(rest[0], Node) and rest[0].tag == "form" and any(re.fullmatch("p|h[1-6]", x.tag) for x in walk(rest[0])):
                rest[0].marked = False
        article |= node.tag == "article"
        todo.extend((k, node.dropped, article) for k in node.kids if isinstance(k, Node))
    for node in reversed(nodes):
        node.holds = not node.dropped and (node.tag in ("article", "main") or any(k.holds for k in node.kids if isinstance(k, Node)))


class Open:
    """The open elements, with the places of each tag, so that none is searched for."""

    def __init__(self, root: Node):
        self.stack, self.places, self.blocks = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, at: int) -> None:
        for node in self.stack[at:]:
            self.places[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()
        del self.stack[at:]


LISTS = ("ul", "ol", "dl", "table", "select")


def parsed(page: str) -> Node:
    """The tree of a page; text stands as strings among the kids. Wrong nesting closes what is open; a "<"
    that no ">" follows begins text. Every step takes time in proportion to what it consumes."""
    root = Node("", "", False, False, False)
    held, at, n, final = Open(root), 0, len(page), page.rfind(">")
    quoted = True  # false once quotes do not pair up to the end of the page
    while at < n:
        start = page.find("<", at)
        if start != at:
            held.stack[-1].kids.append(page[at : start if start >= 0 else n])
            at = start if start >= 0 else n
            continue
        comment = COMMENT.match(page, at + 1) if page.startswith("!--", at + 1) else None
        if comment:
            at = comment.end()
            continue
        m = TAG.match(page, at + 1) if at < final else None
        if not m:  # a plain "<"; behind the last ">" all is text
            end = n if at > final else at + 1
            held.stack[-1].kids.append(page[at:end])
            at = end
            continue
        tag, first = (m[2] or "").lower(), m.end()
        closed = VALUES.match(page, first) if quoted and tag and not m[1] else None
        quoted &= bool(closed) or not tag or bool(m[1])
        at = closed.end() if closed else page.index(">", first) + 1
        if not tag:
            continue
        if m[1]:
            if held.places.get(tag):
                held.close(held.places[tag][-1])
            continue
        source = page[first : at - 1]
        if tag in CLOSES_P and held.last(("p",)) > max((b for b in held.blocks[-2:] if held.stack[b].tag != "p"), default=0):
            held.close(held.last(("p",)))
        if tag in SAME and held.last(SAME[tag]) > held.last(LISTS):
            held.close(held.last(SAME[tag]))
        parent = held.stack[-1]
        if tag in VOID:
            parent.kids.append("\n" if tag == "br" else " " if tag == "hr" else "")
            continue
        node = opened(tag, source, parent)
        parent.kids.append(node)
        if tag in RAW and not source.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
        elif not (source.rstrip().endswith("/") and tag not in BLOCK):
            held.push(node)
    settle(root)
    return root


def text_key(path: str, text: str) -> str:
    """A content node finer than its path: the text of a block there."""
    return f"{path}\n{xxhash.xxh64_intdigest(text) >> 1}"


def blocks(root: Node, removed: set[str]) -> list[tuple[str, str]]:
    """(path, text) of the page's blocks in page order, without dropped and removed branches. What
    holds a declared article is not removed, nor a word in bold or a link within its text."""
    out: list[tuple[str, str]] = []
    held: list[str] = []
    declared = False
    path = ""

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        if text and text_key(path, text) not in removed:
            out.append((path, text))
        held.clear()

    todo: list = [(root, None)]
    while todo:
        node, mode = todo.pop()
        if isinstance(node, str):
            held.append(node)
            path = mode
        elif mode == "end":
            flush()
        elif not node.dropped and (node.holds or node.path not in removed or node.main and node.tag not in BLOCK):
            declared |= node.main
            if node.tag in BLOCK:
                flush()
                todo.append((node, "end"))
            todo.extend((k, node.path) for k in reversed(node.kids))
    flush()
    if declared:
        inside = {n.path for n in walk(root) if n.main}
        return [b for b in out if b[0] in inside]
    return out


def walk(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(k for k in node.kids if isinstance(k, Node))


def features(root: Node) -> Iterator[tuple[str, int, bool]]:
    """(kind and path, feature, whether in declared content) of a page, each once: kind "s" a style of
    children, "c" a text, "t" the text of a block where the page declares no article."""
    seen = set()
    for node in walk(root):
        if not node.path or node.dropped:
            continue
        style = "|".join(k.path if isinstance(k, Node) else "#" for k in node.kids if not isinstance(k, str) or k.strip())
        seen.add((f"s{node.path}", xxhash.xxh64_intdigest(style) >> 1, node.main))
        for k in node.kids:
            if isinstance(k, str) and k.strip():
                seen.add((f"c{node.path}", xxhash.xxh64_intdigest(" ".join(k.split())) >> 1, node.main))
    if not any(n.tag in ("article", "main") and n.holds for n in walk(root)):
        seen |= {(f"t{path}", xxhash.xxh64_intdigest(text) >> 1, False) for path, text in blocks(root, set())}
    yield from seen


def distinct_features(page: str) -> Iterator[tuple[int, list[str], list[int]]]:
    """(print, keys, features) of what a page declares and of the rest. Equal prints have equal rows;
    the rest's print is that of the whole page."""
    found = sorted(features(parsed(page)))
    for part, named in (([x for x in found if x[2]], None), ([x for x in found if not x[2]], found)):
        if part:
            yield xxhash.xxh64_intdigest(repr(named or part)) >> 1, [x[0] for x in part], [x[1] for x in part]


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))


def style_tree(pages: DataFrame) -> DataFrame:
    """The merged tree of each host: host, path, pages, presentation, content (importances, 0 to 1).

    Pages of a host with the same features count once, and so do declared articles with the same
    features on different pages: copies are not taken for a frame.
    Presentation: entropy of the styles to the base of the pages that have the node. Content: one
    less the mean entropy of its texts over those pages. Both are 1 for a node of a single page.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            out = []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for print_, keys, values in distinct_features(page or ""):
                    if (host, print_) not in seen:
                        seen.add((host, print_))
                        out.append((host, print_, keys, values))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "print", "keys", "features"]
            )

    found = pages.mapInArrow(rows, "host string, print long, keys array<string>, features array<long>")
    once = found.groupBy("host", "print").agg(F.first("keys").alias("keys"), F.first("features").alias("features"))
    each = once.select("host", F.explode(F.arrays_zip("keys", "features")).alias("_f"))
    counted = each.groupBy("host", F.col("_f.keys").alias("_key"), F.col("_f.features").alias("feature")).agg(F.count(F.lit(1)).alias("n"))
    counted = counted.select("host", F.substring("_key", 2, 1 << 30).alias("path"), F.substring("_key", 1, 1).alias("kind"), "feature", "n")
    # Summed by kind first: a path's pages are the sum of its styles, one style a page and node.
    x = F.col("n") * F.log("n")
    sums = counted.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == "s", F.col("n"))).alias("pages"),
        F.sum(F.when(F.col("kind") == "s", x)).alias("_xs"),
        F.sum(F.when(F.col("kind") == "c", F.log("n"))).alias("_xc"),
        F.count(F.when(F.col("kind") == "c", 1)).alias("_texts"),
        F.collect_list(F.when((F.col("kind") == "t") & (F.col("n") >= LEAST_PAGES), F.struct("n", "feature"))).alias("often"),
    )
    base = F.log(F.col("pages"))
    one = F.col("pages") < 2
    # Texts on most pages that have the node: as content of their own they are the same everywhere.
    texts = F.transform(F.filter("often", lambda t: t["n"] >= MOST * F.col("pages")), lambda t: t["feature"])
    return sums.select(
        "host", "path", "pages", "_texts", texts.alias("texts"),
        F.when(one, 1.0).otherwise((base - F.col("_xs") / F.col("pages")) / base).alias("presentation"),
        F.when(one | (F.col("_texts") == 0), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("_xc") / F.col("_texts") / base)).alias("content"),
    )


def low_branches(tree: DataFrame) -> DataFrame:
    """host, paths: the nodes with low importance. A node's importance adds its own presentation to
    the content below it, each level weighted by ``GAMMA``; nodes of few pages are left alone."""
    above = F.transform(
        F.sequence(F.lit(2), F.size(F.split("path", ">"))), lambda k: F.array_join(F.slice(F.split("path", ">"), 1, k), ">")
    )
    spread = tree.withColumn("_up", F.explode(above)).withColumn("_depth", F.size(F.split("path", ">")) - F.size(F.split("_up", ">")))
    weight = F.pow(F.lit(GAMMA), F.col("_depth")) * (F.col("_texts") > 0).cast("double")
    own = F.max(F.when(F.col("_depth") == 0, F.col("presentation")))
    joint = spread.groupBy("host", F.col("_up").alias("path")).agg(
        own.alias("_p"), F.sum(weight * F.col("content")).alias("_c"), F.sum(weight).alias("_w"),
        F.max(F.when(F.col("_depth") == 0, F.col("pages"))).alias("pages"),
    )
    value = F.when(F.col("_w") > 0, (1 - GAMMA) * F.col("_p") + GAMMA * F.col("_c") / F.col("_w")).otherwise(F.lit(1.0))
    low = joint.where((F.col("pages") >= LEAST_PAGES) & (value < LOW) & F.col("path").rlike("^>html>body>."))
    texts = tree.select("host", "path", F.explode("texts").alias("_t")).select("host", F.concat_ws("\n", "path", F.col("_t").cast("string")).alias("path"))
    return low.select("host", "path").unionByName(texts).groupBy("host").agg(F.collect_set("path").alias("paths"))


def main_text(pages: DataFrame) -> DataFrame:
    """One row for each page: page_id, url, text, n_chars.

    Null and empty html have an empty text; a null or odd url belongs to the host without a name;
    repeated pages have a row each; an empty table gives none; other columns are not read.
    """
    held = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    tree = staged(style_tree(held.select("host", "html")), "style-tree")
    low = staged(low_branches(tree), "site-tree").withColumnRenamed("host", "_host")
    kind = pages.schema["page_id"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                "\n\n".join(text for _, text in blocks(parsed(page or ""), set(paths or ())))
                for page, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    joined = held.join(low, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "paths")
    return joined.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
