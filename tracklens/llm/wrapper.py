"""Main-text extraction by wrapper induction over the pages of a host.

1. Each page's DOM is reduced to slots: block elements named by tag, classes and id, siblings of one
   name that follow each other being one slot; a slot knows a digest of its own text.
2. Pages of a host whose outermost slots (three levels) have the same names are a layout.  Each layout
   of ``least`` or more different pages has a pivot, its page of most slots; rarer ones go with the host's
   most frequent layout.  A page's slots are aligned with its pivot's by simple tree matching (the
   largest set of matching nodes that keeps names, order and ancestry); a slot the pivot does not have
   goes by its path of names.  Each slot counts the texts it meets over the host's different pages.
3. A slot is template where it holds the text that ``constant`` of its ``least`` or more pages have.  The
   text of a page is what its varying slots hold, in page order, less page furniture: elements that
   by tag, role, class or id are menus, headers, footers, sidebars, notices, adverts, forms, scripts,
   styles or reader comments.  A class or id never marks html, body, main or article, nor what holds
   all of the page's main and article elements; a part of a name marks only as its last word, and not
   where the slots inside vary over the host.  Where a page has an ``article`` or ``main`` element, only what is
   inside counts, and its constant slots stay if all of them are constant.

Of an element with more than 500 runs of children those of one name are one slot, as all pairs of runs are
tried.  Custom elements are blocks, but inline in paragraphs and headings; formulas are inline text.

A host with fewer than ``least`` different pages has no template.  Null html is empty and gives "";
null page_ids are extracted (but are no pivots); a null url is a host of its own ("").  Repeated
rows are each extracted; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as htmllib
import json
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged
from .urls import host_of

# HTML's own sets of elements, and names of page furniture.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|iframe|textarea|select|svg|object|canvas|video|audio|annotation|annotation-xml"
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split())
INLINE |= set("math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
PHRASES = set("p h1 h2 h3 h4 h5 h6".split())
FENCE = set("table ul ol dl article section div main body".split())
FURNITURE_TAGS = set("head title nav footer aside form button dialog menu fieldset".split())
FURNITURE_NAMES = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar aside ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored sponsors "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations comment comments commentlist disqus respond reply replies toolbar pagination pager copyright masthead search contentinfo complementary widget skip".split()
)
HEADER_NAMES = {"header", "site-header", "page-header", "topbar"}
# A name of several parts tells of furniture by its last part, or by the part before words for a place.
PLACES = set("area bar block box buttons column container content form inner items links list menu outer panel posts section slot stories unit wrap wrapper zone".split())
STATES = set("has have no not is with without show hide hidden open closed enable enabled disable disabled layout type format".split())
BODIES = {"html", "body", "main", "article"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + RAW + r")(?=[\s/>])[^>]*(?:(?<=/)>|>.*?(?:</\1\s*>|\Z))|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(r"\s+")
#: Children of an element that are matched one by one (as runs of one name); of more, those of one name are one slot.
RUNS = 500


class Node:
    __slots__ = ("body", "children", "furniture", "hint", "holds", "main", "marked", "name", "parent", "slot", "tag", "text")

    def __init__(self, tag: str, attrs: str, parent: "Node | None"):
        self.tag, self.parent, self.children, self.text, self.slot = tag, parent, [], [], -1
        self.furniture, self.hint, self.main = False, None, bool(parent and parent.main)
        found = {k.lower(): (a or b or c).lower() for k, a, b, c in ATTRIBUTE.findall(attrs)} if attrs and "=" in attrs else {}
        words = f"{found.get('class', '')} {found.get('id', '')}".split()
        self.name = ".".join([tag, *sorted(re.sub(r"\d+", "0", w) for w in words)]) if words else tag
        role = found.get("role", "")
        self.body = tag in BODIES or role in ("main", "article")
        self.holds = int(self.body and tag not in ("html", "body"))
        if self.holds:
            self.main = True
        # by tag, role or a whole name; by a part of a name, which alignment can overrule
        self.marked = 0
        if tag in FURNITURE_TAGS or tag not in BODIES and role in FURNITURE_NAMES or not self.main and tag == "header":
            self.marked = 2
        elif not self.body and words:
            names = FURNITURE_NAMES if self.main else FURNITURE_NAMES | HEADER_NAMES
            self.marked = 2 if names.intersection(words) else int(any(map(hints_at_furniture, words)))


def hints_at_furniture(name: str) -> bool:
    parts = [p for p in re.split(r"[-_]+", name) if p]
    if len(parts) < 2 or STATES.intersection(parts):
        return False
    while len(parts) > 1 and parts[-1] in PLACES:
        parts.pop()
    return parts[-1] in FURNITURE_NAMES


def settle(nodes: list[Node]) -> None:
    """Mark furniture (``nodes``: parents first).  An element that holds all of the page's main elements is none."""
    for n in reversed(nodes):
        if n.parent:
            n.parent.holds += n.holds
    all_ = nodes[0].holds
    for n in nodes[1:]:
        marked = 0 if all_ and n.holds == all_ else n.marked
        n.furniture = n.parent.furniture or marked >= 2
        n.hint = n if marked == 1 else n.parent.hint


def parse(html: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of block elements, and the blocks of text in page order with their elements."""
    root = Node("#root", "", None)
    nodes = [root]
    stack: list[tuple[str, Node]] = [("#root", root)]
    blocks: list[tuple[Node, str]] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            text = SPACE.sub(" ", htmllib.unescape("".join(held))).strip()
            held.clear()
            if text:
                node = stack[-1][1]
                node.text.append(text)
                blocks.append((node, text))

    def close(names: set[str], fence: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                flush()
                del stack[i:]
                return
            if stack[i][0] in fence:
                return

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue  # a comment, a declaration, or an element without text of its own
        tag = tag.lower()
        if m[2] or m[5]:
            if any(t == tag for t, _ in reversed(stack)):
                i = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag)
                if stack[i][1] is not stack[i - 1][1] or stack[-1][1] is not stack[i][1]:
                    flush()  # a block ends
                del stack[i:]
            continue
        if tag in VOID:
            if tag == "br":
                held.append(" ")
            elif tag == "hr":
                close({"p"}, FENCE)
                flush()
            continue
        if tag in INLINE or "-" in tag and stack[-1][1].tag in PHRASES:
            node = stack[-1][1]
            stack.append((tag, node))
            continue
        if tag in CLOSES_P:
            close({"p"}, FENCE)
        elif tag in CLOSED_BY:
            close(CLOSED_BY[tag], FENCE - {"div"})
        flush()
        parent = stack[-1][1]
        node = Node(tag, m[4] or m[7] or "", parent)
        nodes.append(node)
        parent.children.append(node)
        stack.append((tag, node))
    if at < len(html):
        held.append(html[at:])
    flush()
    settle(nodes)
    return root, blocks


def slots(root: Node) -> list:
    """The tree as [name, digest of own text, is main, children], runs of one name being one slot; nodes get their slot's number."""
    number, whole = 0, []
    todo: list[tuple[list[Node], str, list]] = [([root], "#root", whole)]
    while todo:
        nodes, name, siblings = todo.pop()
        for n in nodes:
            n.slot = number
        number += 1
        text = [t for n in nodes for t in n.text]
        kids = [k for n in nodes for k in n.children]
        runs: list[tuple[str, list[Node]]] = []
        for k in kids:
            if runs and runs[-1][0] == k.name:
                runs[-1][1].append(k)
            else:
                runs.append((k.name, [k]))
        for short in (False, True):  # too many to match: one for each name, then one for each tag
            if len(runs) > RUNS:
                by: dict[str, list[Node]] = {}
                for k in kids:
                    by.setdefault(k.tag if short else k.name, []).append(k)
                runs = list(by.items())
        siblings.append([name, _digest("\n".join(text)) if text else 0, int(nodes[0].main), []])
        todo += [(ns, n, siblings[-1][3]) for n, ns in reversed(runs)]
    return whole[0]


def dump(tree: list) -> str:
    """The tree as flat JSON, whatever its depth: of each slot its name, digest, main and number of children."""
    return json.dumps([[*t[:3], len(t[3])] for t in walk(tree)], separators=(",", ":"))


def load(raw: str) -> list:
    whole: list = []
    open_: list[tuple[list, int]] = [(whole, 1)]
    for name, digest, main, n in json.loads(raw):
        while not open_[-1][1]:
            open_.pop()
        into, left = open_.pop()
        open_.append((into, left - 1))
        into.append([name, digest, main, []])
        open_.append((into[-1][3], n))
    return whole[0]


def _digest(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) >> 1 or 1


def walk(tree: list):
    """The slots in the order of their numbers."""
    todo = deque([tree])
    while todo:
        t = todo.popleft()
        yield t
        todo.extendleft(reversed(t[3]))


def layout(tree: list) -> int:
    """A digest of the names of the outermost three levels, whatever their order and number."""
    found, level = set(), [("", k) for k in tree[3]]
    for _ in range(3):
        found.update(f"{path}/{t[0]}" for path, t in level)
        level = [(f"{path}/{t[0]}", k) for path, t in level for k in t[3]]
    return _digest("\n".join(sorted(found)))


def paths(tree: list) -> list[int]:
    """Of each slot, in the order of their numbers, a digest (below 0) of the names and places down to it."""
    out, todo = [], [(tree, 0, 0)]
    while todo:
        t, above, nth = todo.pop()
        own = _digest(f"{above}/{t[0]}/{nth}")
        out.append(-own)
        seen: dict[str, int] = {}
        kids = []
        for k in t[3]:
            seen[k[0]] = seen.get(k[0], -1) + 1
            kids.append((k, own, seen[k[0]]))
        todo.extend(reversed(kids))
    return out


def located(tree: list, pivot: list) -> list[int]:
    """Of each slot, in the order of their numbers, the pivot's slot it matches, else its path."""
    met = align(tree, pivot)
    return [met.get(i, p) for i, p in enumerate(paths(tree))]


def align(a: list, b: list) -> dict[int, int]:
    """Simple tree matching: the slots of ``a`` that match slots of ``b``, by number."""
    number = lambda tree: {id(t): i for i, t in enumerate(walk(tree))}
    na, nb = number(a), number(b)
    best: dict[tuple[int, int], tuple[int, list]] = {}

    def matched(x: list, y: list) -> None:
        """The number of matching nodes of two trees whose roots match, and which children they are; those of their children are known."""
        xs, ys = x[3], y[3]
        m = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, c in enumerate(xs, 1):
            row, up = m[i], m[i - 1]
            for j, d in enumerate(ys, 1):
                v = up[j] if up[j] >= row[j - 1] else row[j - 1]
                if c[0] == d[0] and (w := up[j - 1] + best[id(c), id(d)][0]) > v:
                    v = w
                row[j] = v
        i, j, pairs = len(xs), len(ys), []
        while i and j:
            if m[i][j] == m[i - 1][j]:
                i -= 1
            elif m[i][j] == m[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((xs[i], ys[j]))
        best[id(x), id(y)] = (m[-1][-1] + 1, pairs)

    def match(x: list, y: list) -> None:
        order, todo = [], [(x, y)]  # pairs whose ancestors match too; none comes twice, as a slot has one parent
        while todo:
            c, d = todo.pop()
            order.append((c, d))
            by: dict[str, list] = {}
            for e in d[3]:
                by.setdefault(e[0], []).append(e)
            todo += [(k, e) for k in c[3] for e in by.get(k[0], ())]
        for c, d in reversed(order):
            matched(c, d)

    if a[0] != b[0]:
        return {}
    match(a, b)
    out, todo = {}, [(a, b)]
    while todo:
        x, y = todo.pop()
        out[na[id(x)]] = nb[id(y)]
        todo += best[id(x), id(y)][1]
    return out


def content(root: Node, blocks: list[tuple[Node, str]], template: set[int], varying: set[int] | frozenset = frozenset()) -> str:
    """The main text, given the numbers of the page's template slots and of those whose text varies over the host."""
    overruled = {id(n.hint) for n, _ in blocks if n.hint and n.slot in varying}
    hidden: dict[int, bool] = {}

    def hides(hint: Node | None) -> bool:
        """Whether a hint or one around it stands."""
        chain = []
        while hint and id(hint) not in hidden:
            chain.append(hint)
            hint = hint.parent.hint
        out = bool(hint) and hidden[id(hint)]
        for h in reversed(chain):
            out = hidden[id(h)] = out or id(h) not in overruled
        return out

    kept = [(n, t) for n, t in blocks if not n.furniture and not hides(n.hint)]
    main = [(n, t) for n, t in kept if n.main]
    if main:
        return "\n".join(t for _, t in ([(n, t) for n, t in main if n.slot not in template] or main))
    return "\n".join(t for n, t in kept if n.slot not in template)


def extract(pages: DataFrame, least: int = 5, constant: float = 0.9) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    small_batches(pages.sparkSession)
    url = F.col("url").cast("string")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def reduce(batches):
        for b in batches:
            trees = [slots(parse(h)[0]) for h in b.column(b.schema.get_field_index("html")).to_pylist()]
            raw = [dump(t) for t in trees]
            page, kind, size = [_digest(r) for r in raw], [layout(t) for t in trees], [sum(1 for _ in walk(t)) for t in trees]
            columns = [*b.columns, pa.array(page, pa.int64()), pa.array(kind, pa.int64()), pa.array(size, pa.int32()), pa.array(raw)]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "page", "kind", "size", "tree"])

    # of pages with equal slots and texts one is enough
    reduced = staged(base.mapInArrow(reduce, "page_id bigint, url string, host string, html string, page bigint, kind bigint, size int, tree string"), "z_trees")
    trees = reduced.select("page_id", "host", "page", "kind", "size", "tree")
    ids = trees.groupBy("host", "page", "kind", "size").agg(F.min("page_id").alias("page_id")).where("page_id IS NOT NULL")
    kinds = staged(ids.groupBy("host", "kind").agg(F.count("*").alias("n"), F.max(F.struct("size", (-F.col("page_id")).alias("at"))).alias("best")), "kinds")
    hosts = kinds.groupBy("host").agg(F.sum("n").alias("pages"), F.max(F.struct("n", "best", "kind")).alias("top")).where(F.col("pages") >= least)
    group = F.when(F.col("n") >= least, F.col("kind")).otherwise(F.col("top.kind")).alias("group")
    kinds = staged(kinds.join(hosts, "host").select("host", "kind", group, (-F.col("best.at")).alias("page_id")), "layouts")
    pivots = trees.join(kinds.where(F.col("kind") == F.col("group")), ["host", "kind", "page_id"]).groupBy("host", "group").agg(F.min("tree").alias("pivot"))
    pivots = staged(pivots, "pivots")
    one = trees.join(ids.select("host", "page", "page_id"), ["host", "page", "page_id"]).join(kinds.select("host", "kind", "group"), ["host", "kind"]).select("host", "group", "tree")

    def meet(batches):
        pivot: tuple[str, list] = ("", [])
        for b in batches:
            rows = []
            for host, group, tree, raw in zip(*(b.column(c).to_pylist() for c in ("host", "group", "tree", "pivot"))):
                if raw != pivot[0]:
                    pivot = (raw, load(raw))
                own = load(tree)
                rows += [(host, group, slot, t[1]) for slot, t in zip(located(own, pivot[1]), walk(own)) if t[1]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["host", "group", "slot", "words"])

    met = one.join(pivots, ["host", "group"]).select("host", "group", "tree", "pivot").mapInArrow(meet, "host string, group bigint, slot bigint, words bigint").groupBy("host", "group", "slot", "words").agg(F.count("*").alias("n"))
    judged = met.groupBy("host", "group", "slot").agg(F.max(F.struct("n", "words")).alias("top"), F.sum("n").alias("all")).where(F.col("all") >= least)
    # the constant text of a slot, 0 for one that varies
    text = F.when(F.col("top.n") >= constant * F.col("all"), F.col("top.words")).otherwise(0)
    # slots of at least ``least`` pages
    template = pivots.join(judged.groupBy("host", "group").agg(F.collect_list("slot").alias("slots"), F.collect_list(text).alias("texts")), ["host", "group"])
    template = staged(template, "templates")

    def take(batches):
        pivot: tuple[str, list] = ("", [])
        for b in batches:
            out = []
            for h, raw, numbers, texts in zip(*(b.column(c).to_pylist() for c in ("html", "pivot", "slots", "texts"))):
                root, blocks = parse(h)
                tree, gone, varying = slots(root), set(), set()
                if numbers:
                    if raw != pivot[0]:
                        pivot = (raw, load(raw))
                    known = dict(zip(numbers, texts))
                    for i, (slot, t) in enumerate(zip(located(tree, pivot[1]), walk(tree))):
                        usual = known.get(slot)
                        # the slot must hold the constant text here too, not the page's own
                        if usual and usual == t[1]:
                            gone.add(i)
                        elif usual == 0:
                            varying.add(i)
                out.append(content(root, blocks, gone, varying))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    placed = reduced.select("page_id", "url", "host", "html", "kind").join(kinds.select("host", "kind", "group"), ["host", "kind"], "left").join(template, ["host", "group"], "left")
    return placed.select("page_id", "url", "html", "pivot", "slots", "texts").mapInArrow(take, "page_id bigint, url string, text string, n_chars bigint")
