"""Operator 4, HTML extraction: a site style tree over the pages of each host.

Pages are parsed once, to containers (elements such as div and section that lay a page out) and blocks of text in them. The
containers of a host's pages are merged into its style tree: a node is a place in the tree of child sequences. A
node's presentation importance is the entropy of the layouts found below it, its content importance that of the texts below
it, both to the number of its pages; branches of low importance are removed from each page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, require
from .urlfilter import host_path

#: Weight of content against presentation.
GAMMA = 0.4
#: A container goes if its importance is below this share of that of the most important container beside it ...
SHARE = 0.67
#: ... or if it is below LEAST on half of the host's pages, and of MANY pages, at least: what nearly all pages repeat.
LEAST, MANY = 0.2, 10
#: A node is judged if it is on so many pages, and on this share of the host's.
MIN_PAGES, PART = 3, 0.1
#: On hosts of so many different pages the tree decides; on others names and elements do, and the tree only among what they leave.
TRUSTED = 20
#: So many nodes (32 bytes each) are sent to every task; beyond it pages are joined with their host's.
BROADCAST_NODES = 200_000

# Elements whose content is no markup.
RAW = frozenset("script style noscript iframe textarea xmp noembed noframes".split())
# HTML's void elements, elements inside a line, elements that end an open one of their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS_P = frozenset("html head body".split())
# Elements that hold running text; all others are containers.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address details summary".split())
# Elements and names that say what a branch is for.
HIDDEN = frozenset("select svg template".split())
UNSEEN = HIDDEN | {"head"}
NOISE_TAGS = frozenset("nav footer aside form button menu dialog".split())
MAIN_TAGS = frozenset(("article", "main"))
NOISE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|sponsor(?:ed)?|promo(?:tion)?s?|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|comments?|replies|respond|disqus|"
    r"cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommended|widget|toolbar|pagination|pager|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
#: These are noise only outside the article, which may have a head of its own.
HEAD_NAMES = re.compile(r"(?:^|[\s_-])(?:masthead|header|topbar)(?:$|[\s_-])", re.I)
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article-body|articlebody|post-content|entry-content|main)(?:$|[\s_-])", re.I)


TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
GAP = re.compile(r"[\s/]*")
ATTRIBUTE = re.compile(r"[^\s/>][^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
BARE = re.compile(r"[^\s>]*")
CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


def tokens(page: str) -> Iterator[tuple[str, str, list[tuple[str, str]]]]:
    """(kind, text or tag, [(class, id or role; value)]) with kind text, start or end, in time linear in the page.

    Tags are cut as browsers do: quotes after = protect >; a quote that is never closed is an ordinary
    character; a tag that is never closed is the page's end. Comments, declarations and raw elements are left out.
    """
    at, size, endless = 0, len(page), set()
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], []
            return
        if lt > at:
            yield "text", page[at:lt], []
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        m = TAG.match(page, lt)
        if m is None:
            yield "text", "<", []
            at = lt + 1
            continue
        tag, at, said = m[1].lower(), m.end(), []
        while True:
            at = GAP.match(page, at).end()
            if at >= size:
                return
            if page[at] == ">":
                at += 1
                break
            name = ATTRIBUTE.match(page, at)
            at = name.end()
            equals = EQUALS.match(page, at)
            if equals is None:
                continue
            at, quote, end = equals.end(), page[equals.end() : equals.end() + 1], -1
            if quote and quote in "\"'" and quote not in endless:
                end = page.find(quote, at + 1)
                if end < 0:
                    endless.add(quote)
            if end >= 0:
                value, at = page[at + 1 : end], end + 1
            else:
                bare = BARE.match(page, at)
                value, at = bare[0], bare.end()
            kind = name[0].lower()
            if kind in ("class", "id", "role"):
                said.append((kind, value))
        if page[lt + 1] == "/":
            yield "end", tag, []
            continue
        yield "start", tag, said
        if tag in RAW:
            end = CLOSE[tag].search(page, at)
            if end is None:
                return
            at = end.start()


@dataclass
class Element:
    tag: str
    style: str
    parent: int
    unseen: bool
    noise: bool
    main: bool
    container: bool


@dataclass
class Page:
    """containers: (index of the container around it or -1, node, layout, text below, inside a marked article, named as noise); blocks: (container, marked, named as noise, text)."""

    containers: list[tuple[int, int, int, int, bool, bool]]
    blocks: list[tuple[int, bool, bool, str]]


def _hash(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _together(*parts: int) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(b"".join(p.to_bytes(8, "little", signed=True) for p in parts)) - (1 << 63)


def parse(page: str) -> Page:
    """The containers and the blocks of text of a page, in order, each with what names and elements say of it.

    Elements nest as in browsers in the main: an open p ends before a block, li before li and so on; end
    tags without a start are ignored; what is open at the end is closed.
    """
    elements, stack, is_open = [Element("", "", -1, False, False, False, True)], [0], {}
    texts: list[tuple[int, list[str]]] = []
    now: list[str] | None = None

    def put(piece: str) -> None:
        nonlocal now
        if elements[stack[-1]].unseen:
            return
        if now is None:
            now = []
            texts.append((stack[-1], now))
        now.append(piece)

    def pop() -> None:
        is_open[elements[stack.pop()].tag] -= 1

    for kind, tag, said in tokens(page):
        if kind == "text":
            put(html.unescape(tag) if "&" in tag else tag)
            continue
        if tag == "br":
            put(" ")
            continue
        names = " ".join(v for _, v in said)
        if tag in INLINE and not (kind == "start" and names and NOISE_NAMES.search(names)) and not (kind == "end" and is_open.get(tag)):
            continue
        if tag in RAW:
            continue
        if tag not in HIDDEN and not elements[stack[-1]].unseen:
            now = None
        if kind == "end":
            if is_open.get(tag):
                while elements[stack[-1]].tag != tag:
                    pop()
                pop()
            continue
        if tag in VOID:
            continue
        ends = ENDS.get(tag, set()) | (set() if tag in KEEPS_P or tag in INLINE else {"p"})
        if elements[stack[-1]].tag in ends:
            pop()
        above = elements[stack[-1]]
        main = above.main or tag in MAIN_TAGS or bool(names and MAIN_NAMES.search(names))
        noise = above.noise or tag in NOISE_TAGS or (tag == "header" and not main)
        if names and tag not in ("html", "body", *MAIN_TAGS):
            noise = noise or bool(NOISE_NAMES.search(names)) or (not main and bool(HEAD_NAMES.search(names)))
        style = tag + "".join(f".{v}" for name, v in said if name != "id")
        elements.append(Element(tag, style, stack[-1], above.unseen or tag in UNSEEN, noise, main, tag not in FLOW and tag not in INLINE))
        stack.append(len(elements) - 1)
        is_open[tag] = is_open.get(tag, 0) + 1
    blocks = [(where, text) for where, parts in texts if (text := " ".join("".join(parts).split()))]
    return _merge(elements, blocks)


def _merge(elements: list[Element], blocks: list[tuple[int, str]]) -> Page:
    n = len(elements)
    children: list[list[int]] = [[] for _ in elements]
    for i in range(1, n):
        children[elements[i].parent].append(i)
    own: list[list[int]] = [[] for _ in elements]
    for where, text in blocks:
        own[where].append(_hash(text))
    style = [_hash(e.style) for e in elements]
    layout, below, node = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        layout[i] = _together(style[i], *(layout[c] for c in children[i])) if children[i] else style[i]
        found = own[i] + [below[c] for c in children[i] if below[c]]
        below[i] = _together(*found) if found else 0
    for i in range(n):
        if children[i]:
            sequence = _together(*(style[c] for c in children[i]))
            for k, c in enumerate(children[i]):
                node[c] = _together(node[i], sequence, k)
    near, number = [-1] * n, {}  # the container around each element, and the number of each container with text
    containers = []
    for i, e in enumerate(elements):
        near[i] = i if e.container else near[e.parent]
        if e.container and below[i]:
            around = number[near[e.parent]] if i else -1
            number[i] = len(containers)
            containers.append((around, node[i], layout[i], below[i], i > 0 and elements[e.parent].main, e.noise))
    return Page(containers, [(number[near[where]], elements[where].main, elements[where].noise, text) for where, text in blocks])


def main_text(page: Page, tree: dict[int, tuple[int, float]] | None = None, pages: int = 0) -> str:
    """The article of a page by its host's tree: node to (pages, importance), for the nodes that are judged; pages: the host's."""
    return decided(page, tree or {}, pages)[0]


def decided(page: Page, tree: dict[int, tuple[int, float]], pages: int) -> tuple[str, str]:
    """(the article, tree or names: which of them decided)"""
    text = by_tree(page, tree, pages) if pages >= TRUSTED else ""
    return (text, "tree") if text else (by_names(page, tree, pages), "names")


def _repeats(known: tuple[int, float], pages: int) -> bool:
    return known[0] >= max(MANY, pages / 2) and known[1] < LEAST


def by_tree(page: Page, tree: dict[int, tuple[int, float]], pages: int) -> str:
    """From the outermost container inwards, a container goes if it is much less important than the most important one beside it, or repeats
    itself on most pages. Names and elements count only where the tree has no opinion: of containers that it does not judge, and below containers."""
    best: dict[int, float] = {}
    for around, node, *_ in page.containers:
        if node in tree:
            best[around] = max(best.get(around, 0.0), tree[node][1])
    gone: list[bool] = []
    for around, node, _, _, _, named in page.containers:
        known = tree.get(node)
        low = named if known is None else _repeats(known, pages) or known[1] < SHARE * best[around]
        gone.append((around >= 0 and gone[around]) or low)
    return " ".join(text for where, _, named, text in page.blocks if not gone[where] and (not named or page.containers[where][5]))


def by_names(page: Page, tree: dict[int, tuple[int, float]], pages: int) -> str:
    """What names and elements call noise goes first. What the page marks as its article (article, main) is preferred to all beside it, and loses only what
    repeats itself; without such a mark the tree decides among what is left. If nothing would stay, all that is not called noise stays."""
    blocks = [b for b in page.blocks if not b[2]]
    marked = any(main for _, main, _, _ in blocks)
    holds = [False] * len(page.containers)
    for where, *_ in blocks:
        holds[where] = True
    for i in range(len(holds) - 1, 0, -1):
        if holds[i]:
            holds[page.containers[i][0]] = True
    best: dict[int, float] = {}
    for (around, node, *_), some in zip(page.containers, holds, strict=True):
        if some and node in tree:
            best[around] = max(best.get(around, 0.0), tree[node][1])
    gone: list[bool] = []
    for (around, node, _, _, inside, _), some in zip(page.containers, holds, strict=True):
        known = tree.get(node) if some else None
        low = known is not None and _repeats(known, pages)
        if known is not None and not marked:
            low = low or known[1] < SHARE * best[around]
        gone.append((around >= 0 and gone[around]) or (low and (inside or not marked)))
    found = [b for b in blocks if b[1]] if marked else blocks
    left = [b for b in found if not gone[b[0]]]
    return " ".join(b[3] for b in left or found)


_PARSED = "row long, host long, copy long, around array<int>, node array<long>, layout array<long>, below array<long>, inside array<boolean>, named array<boolean>, at array<int>, marked array<boolean>, noise array<boolean>, text array<string>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [*[pa.int64()] * 3, pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 3, *[pa.list_(pa.bool_())] * 2, pa.list_(pa.int32()), *[pa.list_(pa.bool_())] * 2, pa.list_(pa.string())]
    names = [x.split()[0] for x in _PARSED.split(", ")]
    for batch in batches:
        out: list[list] = []
        for row, host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = page.as_py() or ""
            p = parse(raw)
            out.append([row, host, _hash(raw), *([c[i] for c in p.containers] for i in range(6)), *([b[i] for b in p.blocks] for i in range(4))])
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kinds[i]) for i in range(len(kinds))], names)


def style_tree(parsed: DataFrame) -> DataFrame:
    """(host, node, pages, host_pages, importance) of the nodes that are judged, for pages as _parse gives them. Equal pages of a host count as one."""
    once = parsed.groupBy("host", "copy").agg(F.first(F.struct("node", "layout", "below")).alias("b"))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("c.layout").alias("feature")), F.struct(F.lit(1).alias("kind"), F.col("c.below").alias("feature")))
    each = once.select("host", F.explode(F.arrays_zip("b.node", "b.layout", "b.below")).alias("c")).select("host", "c.node", F.explode(kinds).alias("k"))
    counts = each.groupBy("host", "node", "k.kind", "k.feature").agg(F.count(F.lit(1)).alias("n"))
    n, kind, m = F.col("n"), F.col("kind"), F.ln("pages")
    nlogn = lambda k: F.coalesce(F.sum(F.when(kind == k, n * F.ln(n))), F.lit(0.0))
    nodes = counts.groupBy("host", "node").agg(F.sum(F.when(kind == 0, n)).alias("pages"), nlogn(0).alias("layouts"), nlogn(1).alias("texts"))
    entropy = lambda c: (m - F.col(c) / F.col("pages")) / m
    importance = GAMMA * entropy("texts") + (1 - GAMMA) * entropy("layouts")
    judged = nodes.where(F.col("pages") >= MIN_PAGES).withColumn("importance", importance)
    whole = nodes.where("node = 0").select(F.col("host").alias("of"), F.col("pages").alias("host_pages"))
    # of one host at most 1 / PART nodes stay for each container of a page
    return judged.join(whole, F.col("host") == F.col("of")).where(F.col("pages") >= PART * F.col("host_pages")).select("host", "node", "pages", "host_pages", "importance")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """One row per row of pages: id_col, url, text, n_chars, decided_by (tree or names).

    Scripts, styles and markup go. On hosts of TRUSTED different pages or more the style tree decides which branches stay (see by_tree); on others, and where the
    tree leaves nothing of a page, what branches say they are: menus, headers, footers, sidebars, notices, adverts, forms or comments (see by_names). A layout that
    fewer than PART of a host's pages have is not judged, so a page's result depends on how many pages of other layouts its host has. Null html is empty; pages
    of a null url are one host, and on hosts of fewer than MIN_PAGES different pages only what branches say of themselves counts.
    Rows with repeated or null ids are extracted each on its own; for the tree, equal pages of a host count as one; an empty
    table gives no rows; other columns are ignored.
    """
    require(pages, id_col, url_col, html_col)
    host, _ = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.xxhash64(host).alias("host"), F.col(html_col).alias("html"))
    named = dict(rows.dtypes)["id"]
    # ids and urls pass beside the parser, so that a row stays one row
    kinds = f"id {named}, url string, {_PARSED.removeprefix('row long, ')}"

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = pa.array(range(len(batch)), pa.int64())
            for made in _parse([pa.RecordBatch.from_arrays([index, batch.column(2), batch.column(3)], ["row", "host", "html"])]):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made.columns[1:]], ["id", "url", *made.schema.names[1:]])

    parsed = materialize(rows.mapInArrow(beside, kinds), "parsed")
    tree = materialize(style_tree(parsed), "tree")
    slim, known = parsed.select("id", "url", "host", "around", "node", "inside", "named", "at", "marked", "noise", "text"), None
    if tree.count() <= broadcast_nodes:
        known = {}
        for r in tree.collect():  # bounded just above
            known.setdefault(r.host, (r.host_pages, {}))[1][r.node] = (r.pages, r.importance)
        slim = slim.withColumn("tree", F.array().cast("array<struct<host_pages: bigint, node: bigint, pages: bigint, importance: double>>"))
    else:
        whole = tree.groupBy("host").agg(F.collect_list(F.struct("host_pages", "node", "pages", "importance")).alias("tree"))
        slim = slim.join(whole, "host", "left").select(*slim.columns, "tree")
    shared = pages.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            found = []
            for host, around, node, inside, named, at, marked, noise, text, own in zip(*[batch.column(i).to_pylist() for i in range(2, 12)], strict=True):
                if table is not None:
                    size, nodes = table.get(host, (0, {}))
                else:
                    size, nodes = (own[0]["host_pages"] if own else 0), {x["node"]: (x["pages"], x["importance"]) for x in own or ()}
                page = Page([(a, k, 0, 0, i, n) for a, k, i, n in zip(around, node, inside, named, strict=True)], list(zip(at, marked, noise, text, strict=True)))
                found.append(decided(page, nodes, size))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([f[i] for f in found], pa.string()) for i in range(2)]], ["id", "url", "text", "decided_by"])

    out = slim.mapInArrow(run, f"id {named}, url string, text string, decided_by string")
    return out.select(F.col("id").alias(id_col), "url", "text", F.length("text").cast("long").alias("n_chars"), "decided_by")


def op4_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(documents(spark, sf_dir, "pages"))
