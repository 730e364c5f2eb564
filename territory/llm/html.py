"""Main text of web pages by wrapper induction (operator 2).

Pages of one host and one layout are aligned with a reference page of theirs by simple tree matching: each run of alike
elements is a slot, known by its path in the reference. What all these pages have in a slot tells what it is: a text that
stays the same on most of them is template; a slot whose text is mostly links is a menu; of the slots that vary, the
deepest element that holds most of the text is the article's. Elements and roles that mean a menu, a footer, a form and
the like go anyway; class names that only hint at that count where the slot doesn't say otherwise.
"""

from __future__ import annotations

import functools
import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territory.llm.base import Scratch, read_table, slices

#: Pages of a layout that a wrapper needs; pages and share of them that must agree on a template text.
LEAST_PAGES, LEAST_SHARE = 4, 0.6
#: Share of a slot's characters in links that makes it a menu; share of the varying text that the article's element holds.
MOST_LINKS, MAIN_SHARE = 0.5, 0.75
#: Share of the varying text that a slot with a hint in its class must hold to stay.
HINTED_SHARE = 0.15
#: Nested elements beyond this depth become siblings; pairs of runs that an alignment compares before it takes the first that fits.
DEEPEST, PAIRS = 200, 200_000
#: Characters of a tag's attributes up to which what they say is remembered.
LONG_ATTRIBUTES = 256

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that an open p ends before.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

#: Blocks that come and go with the text.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote figure hr address".split())
#: Elements and roles that aren't article text.
ASIDE = frozenset("nav header footer aside form menu button select option dialog head object canvas audio video map input search".split()) | RAW
ASIDE_ROLE = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Words of classes and ids that mean what isn't article text, and those that only hint at it.
_WORDS = r"(?:^|[\s_-])(?:{})(?=$|[\s_-])"
_ASIDE_CLASS = re.compile(
    _WORDS.format(
        r"ads?|advert\w*|adbox|sponsor\w*|promos?|cookies?|gdpr|popup|nav|navs|navbar|navigation|menu\w*|breadcrumbs?|sidebar|footer|header|masthead|topbar|toolbar"
        r"|comments?|commentlist|disqus|newsletter|subscribe|signup|login|pagination|pager"
    ),
    re.I,
)
_HINT_CLASS = re.compile(r"^side$|(?:^|[\s_-])(?:alert|widgets?|reply|discussion|follow|search|tags|meta|byline)$", re.I)
_COMMENT_CLASS = re.compile(_WORDS.format(r"comments?|commentlist|disqus"), re.I)
#: Words that mean it alone or beside words for parts of a page, as in share-buttons, but not beside others, as in market-share.
_DOUBTFUL = frozenset("notice notices banner consent modal overlay share sharing social related recommended recommendations skip promotion promotions".split())
_DOUBTFUL_COMMENTS = frozenset("replies reply respond response responses".split())
_PAGE_PARTS = frozenset(
    "area article articles bar block blocks body bottom box boxes btn btns button buttons card cards col column container content contents count feed form group heading icon icons inner item items left link links list lists main"
    " media menu message module msg network networks news outer page pages panel post posts product products right row section side site slot stories story strip text title to tool tools top topics unit video videos widget widgets wrap wrapper".split()
)
_CONTAINER_CLASS = re.compile(r"(?:with|without|has|no|is|layout)[-_]|.*-(?:with|has|no|free)(?:-|$)", re.I)

_VALUE = r"""(?:\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]*+)))?+"""
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)" + _VALUE)
_ATTRIBUTES = r"((?>[\s/]++|[^\s/>][^\s/>=]*+" + re.sub(r"\((?!\?)", "(?:", _VALUE) + r")*+)"
_MARKUP = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?=[^a-zA-Z])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)" + _ATTRIBUTES + r"(?:>|(\Z))", re.S)


@functools.lru_cache(4096)
def _class_says(value: str) -> tuple[bool, bool, bool]:
    """Whether a class or id means, or hints at, what isn't article text, or means comments; "has-sidebar" and the like name a container."""
    words = [w for w in value.split() if not _CONTAINER_CLASS.match(w)]
    means, hints, comments = (any(x.search(w) for w in words) for x in (_ASIDE_CLASS, _HINT_CLASS, _COMMENT_CLASS))
    for word in words:
        parts = set(re.split("[_-]+", word.lower())) - {""}
        if all(p in _DOUBTFUL or p in _DOUBTFUL_COMMENTS or p in _PAGE_PARTS or len(p) <= 2 or p.isdigit() or _ASIDE_CLASS.search(p) for p in parts):
            comments |= not parts.isdisjoint(_DOUBTFUL_COMMENTS)
            means |= not parts.isdisjoint(_DOUBTFUL | _DOUBTFUL_COMMENTS)
    return means, hints, comments


class Node:
    """An element: its tag, whether it isn't article text or may not be, and its children, of which text is in strings."""

    __slots__ = ("tag", "aside", "hinted", "children", "key", "runs")

    def __init__(self, tag: str, aside: bool, hinted: bool = False, key: str | None = None) -> None:
        self.tag, self.aside, self.hinted, self.children, self.key = tag, aside, hinted, [], key or tag
        self.runs: list[tuple[str, list[Node]]] | None = None  #: of a whole tree, once they are asked for


def _element(tag: str, attributes: str, stack: list[Node]) -> Node:
    whole = tag in ("html", "body", "main") or tag == "article" and not any(n.tag == "article" for n in stack)
    if not attributes:
        return Node(tag, tag in ASIDE)
    return Node(tag, *(_attributes_say if len(attributes) <= LONG_ATTRIBUTES else _attributes_say.__wrapped__)(tag, attributes, whole))


@functools.lru_cache(4096)
def _attributes_say(tag: str, attributes: str, whole: bool) -> tuple[bool, bool, str]:
    """Whether an element isn't article text or may not be, and its key; `whole` elements hold the page's text."""
    node = Node(tag, tag in ASIDE)
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), a or b or c)
    for name in ("class", "id"):
        if value := found.get(name):
            means, hints, comments = _class_says(entities.unescape(value))
            node.aside |= comments and tag not in ("html", "body", "main") if whole else means or comments and hints
            node.hinted |= hints and not whole
    if value := found.get("class"):
        node.key += f".{value}"
    node.aside |= "hidden" in found or found.get("role", "").lower() in ASIDE_ROLE or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    return node.aside, node.hinted, node.key


def parse(html: str) -> Node:
    """A tree of a page as browsers would build it, near enough: omitted and unmatched end tags, raw text, void elements."""
    root = Node("#root", False)
    stack, at = [root], 0
    while match := _MARKUP.search(html, at):
        if match.start() > at:
            stack[-1].children.append(html[at : match.start()])
        at = match.end()
        tag = match[2]
        if tag is None or match[4] is not None:  # a comment, a declaration, or a tag that the page's end cuts off
            continue
        tag = tag.lower()
        if match[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE:
                    break
        elif tag in SAME:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SAME[tag]:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPE[tag]:
                    break
        node = _element(tag, match[3], stack)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif tag not in VOID and len(stack) < DEEPEST:
            stack.append(node)
    if at < len(html):
        stack[-1].children.append(html[at:])
    return root


def _blocks(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node) and c.tag not in INLINE and c.tag not in VOID and c.tag not in RAW]


def _alike(a: Node, b: Node) -> bool:
    """Whether neighbours are items of one list: the same kind, with mostly the same kinds of blocks inside."""
    if a.key != b.key:
        return False
    if not a.children or not b.children:
        return not _blocks(a) and not _blocks(b)
    x, y = ({c.key for c in _blocks(n)} for n in (a, b))
    return x == y or 2 * len(x & y) > len(x | y)


def _elements(node: Node) -> list[tuple[str, list[Node]]]:
    """Child elements, neighbours that are alike in one run: a list of many items aligns as one slot."""
    if node.runs is None:
        runs: list[tuple[str, list[Node]]] = []
        for child in _blocks(node):
            if runs and _alike(runs[-1][1][-1], child):
                runs[-1][1].append(child)
            else:
                runs.append((child.key, [child]))
        node.runs = runs
    return node.runs


def _aligned(left: list, right: list, left_pairs: list[int]) -> list[tuple[int, int, tuple]]:
    """Runs that align in order, each with the alignment inside: the most nodes, while `left_pairs` of comparisons are left; then the first that fit."""
    m, n = len(left), len(right)
    if not m or not n:
        return []
    if m * n > left_pairs[0]:
        places: dict[str, list[int]] = {}
        for j, (key, _) in enumerate(right):
            places.setdefault(key, []).append(j)
        out, at = [], 0
        for i, (key, nodes) in enumerate(left):
            own = places.get(key, [])
            if (k := bisect_left(own, at)) < len(own):
                out.append((i, own[k], _alignment(nodes, right[own[k]][1], left_pairs)))
                at = own[k] + 1
        return out
    left_pairs[0] -= m * n
    keys = [key for key, _ in left]
    if m == n and len(set(keys)) == m and keys == [key for key, _ in right]:  # each fits its own only, in order
        return [(i, i, _alignment(left[i][1], right[i][1], left_pairs)) for i in range(m)]
    best = [[0] * (n + 1) for _ in range(m + 1)]
    inside = {}
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1])
            if keys[i - 1] == right[j - 1][0]:
                inside[i, j] = _alignment(left[i - 1][1], right[j - 1][1], left_pairs)
                best[i][j] = max(best[i][j], best[i - 1][j - 1] + inside[i, j][0])
    out, i, j = [], m, n
    while i and j:
        if (i, j) in inside and best[i][j] == best[i - 1][j - 1] + inside[i, j][0]:
            out.append((i - 1, j - 1, inside[i, j]))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _alignment(a: list[Node], b: list[Node], left_pairs: list[int]) -> tuple:
    """Simple tree matching of two runs of alike elements: the most nodes that align in order, and which, (number in a, nodes of a, nodes of b, alignment inside)."""
    left = [r for node in a for r in _elements(node)]
    right = [r for node in b for r in _elements(node)]
    if len(a) > 1 or len(b) > 1:  # items of a run share one shape
        left, right = _merged(left), _merged(right)
    found = [(i, left[i][1], right[j][1], inside) for i, j, inside in _aligned(left, right, left_pairs)]
    return 1 + sum(inside[0] for *_, inside in found), found


def _paths(alignment: tuple, path: str, pairs: list) -> None:
    for i, one, other, inside in alignment[1]:
        here = f"{path}/{i}"
        pairs.append((here, one, other))
        _paths(inside, here, pairs)


def match(a: list[Node], b: list[Node], pairs: list | None = None, path: str = "", left_pairs: list[int] | None = None) -> int:
    """The most nodes of two runs of alike elements that align in order; with `pairs`, also the alignment: (path in a, nodes of a, nodes of b)."""
    found = _alignment(a, b, [PAIRS] if left_pairs is None else left_pairs)
    if pairs is not None:
        _paths(found, path, pairs)
    return found[0]


def _merged(runs: list[tuple[str, list[Node]]]) -> list[tuple[str, list[Node]]]:
    out: dict[str, list[Node]] = {}
    for key, nodes in runs:
        out.setdefault(key, []).extend(nodes)
    return list(out.items())


def clean(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


def digest(text: str) -> str:
    """What is shuffled and kept of a slot's text: 128 bits, as hexadecimal digits."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def own_text(node: Node) -> str:
    """The text of an element and its inline elements, outside of blocks."""
    parts: list[str] = []

    def walk(n: Node) -> None:
        for child in n.children:
            if isinstance(child, str):
                parts.append(child)
            elif child.tag in INLINE:
                walk(child)
            elif child.tag not in RAW:
                parts.append(" ")

    walk(node)
    return clean(parts)


def _linked(node: Node) -> str:
    """The text of links among an element's own text."""
    parts: list[str] = []

    def walk(n: Node, inside: bool) -> None:
        for child in n.children:
            if isinstance(child, str):
                if inside:
                    parts.append(child)
            elif child.tag in INLINE:
                walk(child, inside or child.tag == "a")

    walk(node, False)
    return clean(parts)


def slots(reference: Node, page: Node) -> list[tuple[str, Node, str]]:
    """(path, node, text) for each text of the page under a node that aligns with the reference."""
    pairs: list = []
    match([reference], [page], pairs)
    return [(path, node, text) for path, _, nodes in pairs for node in nodes if (text := own_text(node))]


def layout(root: Node) -> str:
    """The containers below the body, or below the only block there: pages of one layout share a wrapper."""
    node = next((c for n in (root, *[c for c in root.children if isinstance(c, Node)]) for c in n.children if isinstance(c, Node) and c.tag == "body"), root)
    while len(runs := _elements(node)) == 1 and len(runs[0][1]) == 1:
        node = runs[0][1][0]
    return " ".join(key for key, run in runs if run[0].tag not in TEXT_BLOCKS)


class Wrapper:
    """What a layout's slots are: template texts, slots that aren't article text, and the element that holds the article."""

    def __init__(self, pages: int, rows: list[dict], reference: Node) -> None:
        """rows: path, text's digest, pages that have it there, its characters and those in links, of each text of a slot."""
        need = max(LEAST_PAGES, pages * LEAST_SHARE)
        self.template = {(r["path"], r["text"]) for r in rows if r["pages"] >= need}
        own: dict[str, list[int]] = {}
        for r in rows:
            if r["pages"] < need:
                sums = own.setdefault(r["path"], [0, 0])
                sums[0] += r["chars"]
                sums[1] += r["links"]
        nodes: dict[str, list[Node]] = {}
        pairs: list = []
        match([reference], [reference], pairs)
        for path, run, _ in pairs:
            nodes[path] = run
        whole: dict[str, list[int]] = {}
        for path, sums in own.items():
            while path:
                up = whole.setdefault(path, [0, 0])
                up[0] += sums[0]
                up[1] += sums[1]
                path = path.rpartition("/")[0]
        shown = {path: sums for path, sums in whole.items() if not any(n.aside for n in self._above(path, nodes))}
        menus = {path for path, (chars, links) in shown.items() if links > MOST_LINKS * chars}
        article = {path for path, run in nodes.items() if any(n.tag in ("article", "main") for n in run)}
        top = {path: chars - links for path, (chars, links) in shown.items() if path.count("/") == 1}
        total = sum(top.values())
        #: without an article or main element, the deepest single element with blocks of its own that holds most of what varies
        self.main = None
        if not article and total:
            held = [p for p, (chars, links) in shown.items() if chars - links >= MAIN_SHARE * total and len(nodes.get(p, ())) == 1 and _elements(nodes[p][0])]
            self.main = max(held, key=lambda p: p.count("/"), default=None)
        outside = [p for p in shown if article and not any(p == a or p.startswith(f"{a}/") for a in article)]
        self.drop = {p for p in menus if self.main and p != self.main and not self.main.startswith(f"{p}/")} | {p for p in outside if p in menus}
        #: a class that hints at what isn't article text counts for a slot that holds little
        self.keep = {p for p, (chars, links) in whole.items() if total and chars - links >= HINTED_SHARE * total and p not in menus}

    @staticmethod
    def _above(path: str, nodes: dict[str, list[Node]]) -> list[Node]:
        out: list[Node] = []
        while path:
            out += nodes.get(path, [])[:1]
            path = path.rpartition("/")[0]
        return out

    def apply(self, reference: Node, page: Node) -> tuple[set[int], set[int], set[int]]:
        """Nodes of a page: those whose own text goes, those that go whole, and the article's; hints that don't count are taken off."""
        pairs: list = []
        match([reference], [page], pairs)
        texts, gone, main = set(), set(), set()
        for path, _, run in pairs:
            for node in run:
                if path == self.main:
                    main.add(id(node))
                if path in self.drop:
                    gone.add(id(node))
                if path in self.keep:
                    node.hinted = False
                if (path, digest(own_text(node))) in self.template:
                    texts.add(id(node))
        return texts, gone, main


def article(root: Node, texts: set[int] = frozenset(), gone: set[int] = frozenset(), main: set[int] = frozenset()) -> str:
    """The text of all blocks that are article text and not dropped; within the article's elements, if there are any."""
    tops: list[Node] = []

    def find(node: Node, wanted) -> None:
        for child in node.children:
            if isinstance(child, Node) and not child.aside:
                if wanted(child):
                    tops.append(child)
                else:
                    find(child, wanted)

    find(root, lambda n: n.tag in ("article", "main"))
    if not tops and main:
        find(root, lambda n: id(n) in main or n.tag == "h1")
    blocks: list[str] = []
    parts: list[str] = []

    def end() -> None:
        if text := clean(parts):
            blocks.append(text)
        parts.clear()

    def walk(node: Node, dropped: bool, heading: bool) -> None:
        silent = dropped or id(node) in texts
        for child in node.children:
            if isinstance(child, str):
                if not silent and not heading:
                    parts.append(child)
            elif child.aside or child.hinted or id(child) in gone:
                if inside and child.tag == "header" and id(child) not in gone:  # of an article's own header its headings stay
                    end()
                    walk(child, False, True)
                elif child.tag not in INLINE:
                    end()
            elif child.tag in INLINE:
                walk(child, silent, heading)
            elif child.tag == "br":
                parts.append(" ")
            else:
                end()
                walk(child, False, heading and not re.fullmatch("h[1-6]|hgroup", child.tag))
                end()

    inside = bool(tops)
    for top in tops or [root]:
        walk(top, False, False)
        end()
    return " ".join(blocks)


@functools.lru_cache(64)
def _reference(html: str) -> Node:
    return parse(html)


@functools.lru_cache(64)
def _wrapper(html: str, pages: int, slots: str) -> Wrapper:
    return Wrapper(pages, [{"text": None} | r for r in json.loads(slots)], _reference(html))


def extract(html: str, reference: str | None = None, pages: int = 0, slots: str = "[]") -> str:
    """Main text of a page; with the layout's reference and what its pages have in their slots, as JSON, through the wrapper."""
    root = parse(html)
    if reference is None:
        return article(root)
    return article(root, *_wrapper(reference, pages, slots).apply(_reference(reference), root))


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        found = [layout(parse(h or "")) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "layout"])


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The host, layout and mark of each page, without the page."""
    for batch in _layouts(batches):
        yield batch.select(["host", "layout", "mark"])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each page: the digests of its slots' distinct texts, with their characters and those of them in links."""
    slot = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string()), ("chars", pa.int64()), ("links", pa.int64())]))
    for batch in slices(batches, "html"):
        out = []
        for reference, html in zip(batch.column("reference").to_pylist(), batch.column("html").to_pylist(), strict=True):
            seen: dict[tuple[str, str], tuple[int, int]] = {}
            for path, node, text in slots(_reference(reference), parse(html)):
                seen[path, digest(text)] = len(text), len(_linked(node))
            out.append([dict(zip(("path", "text", "chars", "links"), (*key, *n), strict=True)) for key, n in seen.items()])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("host", "layout", "mark")), pa.array(out, slot)], names=["host", "layout", "mark", "slots"])


def wrappers(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, layout, reference, pages, slots) of (host, html), from all distinct pages of each layout.

    A slot's texts that most pages have are told each, by their digests; those that few have are one row of sums, without
    a text. Pages aren't shuffled: they are told apart by marks, and what is dealt of them are digests.
    """
    known = pages.where("html is not null and html <> ''").select("host", "html", F.xxhash64("html").alias("mark"))
    by = ["host", "layout"]
    marks = known.mapInArrow(_marks, "host string, layout string, mark long")
    counts = marks.distinct().groupBy(*by).agg(F.count("*").alias("pages"), F.min("mark").alias("mark")).where(F.col("pages") >= LEAST_PAGES)
    counts = scratch.write(counts, "counts")
    reference = scratch.write(known.join(counts, ["host", "mark"]).groupBy(*by).agg(F.min("html").alias("reference"), F.first("pages").alias("pages")), "reference")
    laid = known.mapInArrow(_layouts, "host string, html string, mark long, layout string")
    votes = laid.join(reference, by).select(*by, "mark", "reference", "html")
    votes = votes.mapInArrow(_votes, "host string, layout string, mark long, slots array<struct<path string, text string, chars long, links long>>")
    votes = votes.dropDuplicates([*by, "mark"]).select(*by, F.inline("slots"))
    votes = votes.groupBy(*by, "path", "text").agg(F.count("*").alias("votes"), F.sum("chars").alias("chars"), F.sum("links").alias("links")).join(reference.select(*by, "pages"), by)
    often = F.col("votes") >= F.greatest(F.lit(LEAST_PAGES), F.col("pages") * LEAST_SHARE)
    texts = votes.groupBy(*by, "path", F.when(often, F.col("text")).alias("text")).agg(F.when(F.max(often), F.max("votes")).otherwise(0).alias("pages"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    found = texts.groupBy(*by).agg(F.to_json(F.sort_array(F.collect_list(F.struct("path", "text", "pages", "chars", "links")))).alias("slots"))
    return scratch.write(found.join(reference, by), "wrappers")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = []
        for html, reference, pages, found in zip(*(batch.column(c).to_pylist() for c in ("html", "reference", "pages", "slots")), strict=True):
            texts.append(extract(html or "", reference, pages or 0, found or "[]"))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(df: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of (page_id, url, html).

    A null html counts as empty and has an empty text; a null or odd url belongs to the host ''. Rows that repeat are
    returned each, and are one page for the wrapper. A layout of fewer than LEAST_PAGES distinct pages of a host has no
    wrapper: then elements, roles and classes decide. Very long pages are aligned in bounded time. Other columns aren't
    read; an empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession)
    pages = df.select("page_id", "url", F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema)
    found = pages.mapInArrow(_layouts, f"{schema}, layout string").join(wrappers(pages, scratch), ["host", "layout"], "left")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return found.select("page_id", "url", "html", "reference", "pages", "slots").mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages"))
