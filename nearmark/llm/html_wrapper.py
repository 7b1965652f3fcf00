"""Main text of web pages by wrappers: union-free regular expressions inferred from pages of one host.

Pages become token streams of tags and texts.  A stream is first folded: consecutive groups of the same shape
become one repeated group.  Streams of one shape merge, and those of all shapes of a host are aligned one after
the other; what only one side has becomes an optional group, texts that differ become slots and texts that never
do are template text.  The wrapper tells for each tag path whether its text is template or slot, and how much slot
text it holds; a page's main path is that of its own which holds most on the pages that have it.  A page's main text
is what lies in its main path, or in the article (or main) element that holds the path, less template text and less
the parts that by tag, class, id or role are menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles or comments (a header or footer inside an article is the article's own and stays).  Only pages of which no
path has slot text go by their article element alone; decided_by() counts both kinds.

Fitting reads every different page of a host whole, copies once.  Batches merge their pages by shape; then shapes
are aligned in rounds, FAN_IN to a group and group by group in a stream, until a host has one wrapper, in an order
that doesn't depend on the partitions.  Hosts with one page get the rules without a wrapper.

Defined results: null and empty html gives an empty text; null urls share one host; broken or cut off markup is
read as far as it goes, in time proportional to its length: a tag whose end no quoting leads to ends at the next '>',
as do all tags after it; elements nested deeper than DEPTH count as part of that ancestor; of equally large paths the
last by name is the main one; a very long page is one row like any other; rows that repeat a page_id are extracted
each; an empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

import html
import json
import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, lookup

#: Pages that a template text stands on at least, and its characters at most.
TEMPLATE_PAGES = 3
TEMPLATE_CHARS = 200
#: Wrappers of a host that are aligned in one group of a round, about.
FAN_IN = 64
#: Tag paths tell elements apart down to this depth.
DEPTH = 60
#: Pieces of two streams between common prefix, suffix and unique tokens are compared in full up to this product of
#: their lengths; larger ones count as different.
MOST_CELLS = 4_000_000
MOST_PERIOD = 24
#: Wrappers, and the ids of repeated pages, are broadcast up to this many bytes in all; more are
#: joined through a shuffle.
WRAPPER_BYTES = 8_000_000
#: Bytes of a repeated page's row besides its host.
CHOSEN_BYTES = 40

#: Fixed sets of HTML: elements without content, raw text elements, inline elements, elements a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Elements and words in class, id or role that mark what is not main text.
APART = frozenset("nav header footer aside form script style noscript template iframe svg button select textarea head title menu dialog canvas object".split())
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent notice notices sidebar navbar nav "
    "navigation menu breadcrumb breadcrumbs footer header masthead comment comments reply replies respond disqus "
    "newsletter subscribe signup login complementary contentinfo search".split()
)
#: Those of them that are an article's own inside an article.
OWN_PARTS = frozenset("header footer".split())

#: Elements that hold a page or its article whole, whatever their classes say.
WHOLE = frozenset("html body main article".split())

_START = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*))")
#: The rest of a tag; only after '=' does a quote begin a value.  Nothing is given back, so it takes one pass.
_REST = re.compile(r"""((?:[^>=]|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
#: One attribute after the other, so that neither a part of a name nor a value's content is taken for one.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_PARTS = re.compile(r"[^a-z0-9]+")


@dataclass(slots=True)
class Token:
    kind: str  # 'open', 'close', 'text', 'break'
    name: str  # tag with classes, or the text
    tag: str = ""
    apart: bool = False


def tokens(page: str | None) -> Iterator[Token]:
    """Tags and texts in page order; comments, declarations and raw text elements are left out."""
    page, at, quotes = page or "", 0, True
    last, lower, size = page.rfind(">"), None, len(page)
    while True:
        m = _START.search(page, at)
        if m and m.start() > last and m[0] != "<!--":
            m = None  # nothing closes any more
        text = page[at : m.start() if m else size]
        if text:
            yield Token("text", text)
        if not m:
            return
        at = m.end()
        if m[2] is None:
            close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
            end = page.find(close, at)
            if end < 0 and m[0] == "<![CDATA[":
                close, end = ">", page.find(">", at)
            at = end + len(close) if end >= 0 else size
            continue
        rest = _REST.match(page, at) if quotes else None
        if not rest:
            quotes, end = False, page.find(">", at)
            inner, at = page[at:end], end + 1
        else:
            inner, at = rest[1], rest.end()
        tag = m[2].lower()
        if m[1]:
            yield Token("close", tag, tag)
            continue
        if tag in RAW and not inner.endswith("/"):
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{tag}", at)
            close = page.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else size
            continue
        if tag == "br":
            yield Token("break", tag, tag)
            continue
        words, hidden = set(), False
        for a in _ATTRIBUTE.finditer(inner) if inner else ():
            name, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
            if name in ("hidden", "aria-hidden"):
                hidden |= name == "hidden" or value == "true"
            elif name in ("class", "id", "role"):
                words.update(w for w in _PARTS.split(value) if w)
        label = tag + "".join(f".{w}" for w in sorted(words) if not w.isdigit())
        marked = tag not in WHOLE and not APART_WORDS.isdisjoint(words)
        yield Token("open", label, tag, hidden or tag in APART or marked)
        if tag in VOID or inner.endswith("/"):
            yield Token("close", tag, tag)


def clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


@dataclass(slots=True)
class Block:
    text: str
    path: str
    article: bool  # in an article or main element
    apart: bool  # in a part that is no main text


@dataclass(slots=True)
class Open:
    """An open element: its tag, the path of the block elements down to it, and whether it or one around it is ..."""

    tag: str
    path: str
    depth: int
    article: bool
    apart: bool


def events(page: str | None) -> Iterator[Block | Token]:
    """The page's blocks of text, white space and references resolved, and its tags that aren't inline, in order."""
    stack: list[Open] = []
    of_tag: Counter = Counter()
    now: list[str] = []
    root = Open("", "", 0, False, False)

    def flush() -> Iterator[Block]:
        if now and (text := clean("".join(now))):
            top = stack[-1] if stack else root
            yield Block(text, top.path, top.article, top.apart)
        now.clear()

    def push(t: Token) -> None:
        top = stack[-1] if stack else root
        apart = t.apart and not (top.article and t.tag in OWN_PARTS and t.name == t.tag)
        path, depth = top.path, top.depth
        if t.tag not in INLINE:
            depth += 1
            path = path if depth > DEPTH else f"{path}/{t.name}" if path else t.name
        stack.append(Open(t.tag, path, depth, top.article or t.tag in ("article", "main"), top.apart or apart))
        of_tag[t.tag] += 1

    def pop_to(tag: str) -> Iterator[Token]:
        if of_tag[tag]:
            while True:
                t = stack.pop()
                of_tag[t.tag] -= 1
                if t.tag not in INLINE:
                    yield Token("close", t.tag, t.tag)
                if t.tag == tag:
                    return

    for t in tokens(page):
        if t.kind == "text":
            now.append(t.name)
        elif t.kind == "break":
            now.append(" ")
        elif t.kind == "open":
            if t.tag not in INLINE or t.apart:
                yield from flush()
            if t.tag in CLOSES_P and of_tag["p"]:
                yield from pop_to("p")
            elif t.tag in CLOSED_BY and stack and stack[-1].tag in CLOSED_BY[t.tag]:
                yield from pop_to(stack[-1].tag)
            push(t)
            if t.tag not in INLINE:
                yield t
        else:
            if t.tag not in INLINE or (stack and stack[-1].apart):
                yield from flush()
            yield from pop_to(t.tag)
    yield from flush()


def blocks(page: str | None) -> list[Block]:
    """The page's blocks of text with where they are."""
    return [e for e in events(page) if isinstance(e, Block)]


@dataclass(slots=True)
class Node:
    """A piece of a wrapper: a tag, a text (constant or slot), an optional group or a repeated group."""

    kind: str  # 'tag', 'text', 'optional', 'repeat'
    key: str
    texts: set[str] = field(default_factory=set)  # of a text: the least two seen; two make a slot
    seen: int = 0  # pages that have it
    size: int = 0  # characters of its texts, but for parts that are no main text
    inner: list[Node] = field(default_factory=list)

    @property
    def shape(self) -> str:
        if self.kind in ("tag", "text"):
            return self.key
        return f"({''.join(n.shape for n in self.inner)})" + ("?" if self.kind == "optional" else "+")


def page_nodes(page: str) -> list[Node]:
    out = []
    for e in events(page):
        if isinstance(e, Block):
            out.append(Node("text", f"#{e.path}", {e.text[: TEMPLATE_CHARS + 1]}, 1, 0 if e.apart else len(e.text)))
        else:
            out.append(Node("tag", f"<{e.name}>" if e.kind == "open" else f"</{e.tag}>", seen=1))
    return out


def fold(nodes: list[Node]) -> list[Node]:
    """Replace runs of groups of one shape by repeated groups, short groups first."""
    for period in range(1, MOST_PERIOD + 1):
        shapes, out, i = [n.shape for n in nodes], [], 0
        while i < len(nodes):
            j = i + period
            if j < len(nodes) and shapes[j] == shapes[i]:
                while j + period <= len(nodes) and shapes[j : j + period] == shapes[i : i + period]:
                    j += period
            if j > i + period and (period > 1 or nodes[i].kind != "repeat"):
                body = nodes[i : i + period]
                for k in range(i + period, j, period):
                    body = [merge(a, b, same=True) for a, b in zip(body, nodes[k : k + period], strict=True)]
                out.append(Node("repeat", "", seen=1, inner=body))
                i = j
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def merge(a: Node, b: Node, same: bool = False) -> Node:
    """One node for two of the same shape, of the same page or of different ones."""
    seen = max(a.seen, b.seen) if same else a.seen + b.seen
    if a.kind == "text":
        return Node("text", a.key, set(sorted(a.texts | b.texts)[:2]), seen, a.size + b.size)
    inner = [merge(x, y, same) for x, y in zip(a.inner, b.inner, strict=True)]
    return Node(a.kind, a.key, set(), seen, 0, inner)


def align(wrapper: list[Node], page: list[Node]) -> list[Node]:
    """The wrapper of two wrappers (a page is one): common nodes merge; a group met once matches its repetition; the
    rest is optional."""

    def bare(nodes: list[Node]) -> list[Node]:
        return [x for n in nodes for x in (n.inner if n.kind == "optional" else [n])]

    optional = {id(x) for n in (*wrapper, *page) if n.kind == "optional" for x in n.inner}
    a, b = bare(wrapper), bare(page)
    out: list[Node] = []

    def add_optional(nodes: list[Node]) -> None:
        if nodes:
            out.append(Node("optional", "", seen=1, inner=nodes))

    for op, i1, i2, j1, j2 in opcodes([n.shape for n in a], [n.shape for n in b]):
        if op == "equal":
            for x, y in zip(a[i1:i2], b[j1:j2], strict=True):
                both = merge(x, y)
                add_optional([both]) if id(x) in optional or id(y) in optional else out.append(both)
            continue
        left, right = a[i1:i2], b[j1:j2]
        if len(left) == 1 and left[0].kind == "repeat" and [n.shape for n in left[0].inner] == [n.shape for n in right]:
            out.append(merge(left[0], Node("repeat", "", seen=max(n.seen for n in right), inner=right)))
        elif len(right) == 1 and right[0].kind == "repeat" and [n.shape for n in right[0].inner] == [n.shape for n in left]:
            out.append(merge(Node("repeat", "", seen=max(n.seen for n in left), inner=left), right[0]))
        else:
            add_optional(left)
            add_optional(right)
    return out


def opcodes(a: list[str], b: list[str]) -> list[tuple[str, int, int, int, int]]:
    """Pieces of a and b that are equal or not, in order: ('equal' or 'replace', begin and end in a, and in b).

    Common beginnings and ends are equal; between, tokens that either side has once and that come in the same order
    divide the streams where the rest is too long to compare in full."""
    out: list[tuple[str, int, int, int, int]] = []

    def add(op: str, i1: int, i2: int, j1: int, j2: int) -> None:
        if i1 < i2 or j1 < j2:
            if out and out[-1][0] == op:
                i1, j1 = out[-1][1], out.pop()[3]
            out.append((op, i1, i2, j1, j2))

    todo = [(0, len(a), 0, len(b))]
    while todo:
        i1, i2, j1, j2 = todo.pop()
        i, j = i1, j1
        while i < i2 and j < j2 and a[i] == b[j]:
            i, j = i + 1, j + 1
        add("equal", i1, i, j1, j)
        k = 0
        while i < i2 - k and j < j2 - k and a[i2 - k - 1] == b[j2 - k - 1]:
            k += 1
        x, y = i2 - k, j2 - k
        if (x - i) * (y - j) <= MOST_CELLS:
            for op, p1, p2, q1, q2 in SequenceMatcher(None, a[i:x], b[j:y], autojunk=False).get_opcodes():
                add("equal" if op == "equal" else "replace", i + p1, i + p2, j + q1, j + q2)
            add("equal", x, i2, y, j2)
            continue
        ours, theirs = Counter(a[i:x]), Counter(b[j:y])
        at = {s: q for q, s in enumerate(b[j:y], j) if theirs[s] == 1 and ours[s] == 1}
        anchors, reached = [], j - 1
        for p in range(i, x):
            q = at.get(a[p], -1)
            if q > reached:
                anchors.append((p, q))
                reached = q
        if not anchors:
            add("replace", i, x, j, y)
            add("equal", x, i2, y, j2)
            continue
        cuts = [(i, j), *anchors, (i2, j2)]
        todo += [(p, p2, q, q2) for (p, q), (p2, q2) in zip(cuts, cuts[1:], strict=False)][::-1]
    return out


def infer(pages: list[str]) -> list[Node]:
    """The wrapper of pages, from first to last."""
    wrapper: list[Node] = []
    for k, page in enumerate(pages):
        nodes = fold(page_nodes(page))
        wrapper = nodes if k == 0 else align(wrapper, nodes)
    return wrapper


def expression(wrapper: list[Node]) -> str:
    """The wrapper as a union-free regular expression; '#' is a slot."""

    def one(n: Node) -> str:
        if n.kind == "tag":
            return n.key
        if n.kind == "text":
            return "#" if len(n.texts) > 1 else next(iter(n.texts))
        return f"({''.join(map(one, n.inner))})" + ("?" if n.kind == "optional" else "+")

    return "".join(map(one, wrapper))


def by_shape(parts: Iterable[tuple[int, list[Node]]]) -> dict[str, tuple[int, list[Node]]]:
    """Pages and nodes for each shape; merging is free of order, so it doesn't matter which task met which pages."""
    out: dict[str, tuple[int, list[Node]]] = {}
    for n, nodes in parts:
        shape = "".join(x.shape for x in nodes)
        if shape in out:
            n, nodes = n + out[shape][0], [merge(x, y) for x, y in zip(out[shape][1], nodes, strict=True)]
        out[shape] = (n, nodes)
    return out


def joined(parts: Iterable[tuple[int, list[Node]]]) -> tuple[int, list[Node]]:
    """Pages and wrapper of several wrappers, from first to last."""
    pages, wrapper = 0, []
    for n, nodes in parts:
        wrapper = align(wrapper, nodes) if pages else nodes
        pages += n
    return pages, wrapper


def summary(wrapper: list[Node]) -> dict:
    """What extraction needs of the wrapper: the slot text a page by path, and the template texts by path.

    A text is template if it is the only one at its place and stands on TEMPLATE_PAGES pages or more; pages of
    another layout need not have it."""
    sizes, on, template = Counter(), Counter(), {}

    def walk(nodes: list[Node]) -> None:
        for n in nodes:
            if n.kind == "text":
                path = n.key[1:]
                if len(n.texts) == 1 and n.seen >= TEMPLATE_PAGES and len(text := next(iter(n.texts))) <= TEMPLATE_CHARS:
                    template.setdefault(path, set()).add(text)
                elif n.size:
                    parent = path.rpartition("/")[0] or path
                    sizes[parent] += n.size
                    on[parent] = max(on[parent], n.seen)
            walk(n.inner)

    walk(wrapper)
    return {"main": {p: sizes[p] / on[p] for p in sorted(sizes)}, "template": {p: sorted(template[p]) for p in sorted(template)}}


def main_text(page: str | None, learned: dict | None) -> str:
    """The page's main text, blocks joined by line feeds."""
    return decide(page, learned)[0]


def decide(page: str | None, learned: dict | None) -> tuple[str, bool]:
    """The page's main text, and whether its host's wrapper decided where that is."""
    found = [b for b in blocks(page) if not b.apart]
    if learned:
        found = [b for b in found if b.text not in learned["template"].get(b.path, ())]
        inside = in_main(found, learned["main"])
        if inside:
            return "\n".join(b.text for b in inside), True
    return "\n".join(b.text for b in [b for b in found if b.article] or found), False


def in_main(found: list[Block], sizes: dict[str, float]) -> list[Block]:
    """The blocks in that of the page's own paths which holds most slot text on the pages that have it; of a path in
    an article (or main) element, all that the element holds."""
    own = set()
    for path in {b.path for b in found}:
        while path and path not in own:
            own.add(path)
            path = path.rpartition("/")[0]
    main = max(own & sizes.keys(), key=lambda p: (sizes[p], p), default="")
    tags = main.split("/")
    for k, name in enumerate(tags):
        if name.split(".")[0] in ("article", "main"):
            main = "/".join(tags[: k + 1])
            break
    return [b for b in found if main and (b.path == main or b.path.startswith(main + "/"))]


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def different(pages: DataFrame, space: Workspace) -> DataFrame:
    """host and html of each different page of each host."""
    texts = pages.where("html is not null").select(host(F.col("url")).alias("host"), F.xxhash64("html").alias("at"), "page_id", "html")
    counts = texts.groupBy("host", "at").agg(F.min("page_id").alias("_id"), F.count("*").alias("_n"))
    repeated = space.keep(counts.where("_n > 1").select(F.col("host").alias("_host"), F.col("at").alias("_at"), "_id"), "repeated")
    same = (F.col("host") == F.col("_host")) & (F.col("at") == F.col("_at"))
    if (repeated.agg(F.sum(F.octet_length("_host") + CHOSEN_BYTES)).first()[0] or 0) <= WRAPPER_BYTES:
        marked = texts.join(F.broadcast(repeated), same, "left")
        single, copies = marked.where("_at is null"), marked.where("_at is not null and page_id <=> _id")
    else:  # ids decide, so that copies of a page don't meet
        ids = space.keep(counts.select(F.col("host").alias("_host"), F.col("at").alias("_at"), "_id", "_n"), "ids")
        marked = texts.join(ids, same & texts["page_id"].eqNullSafe(F.col("_id")))
        single, copies = marked.where("_n = 1"), marked.where("_n > 1")
    # Rows that repeat page_id and html are settled in their own task first.
    return single.select("host", "at", "html").unionByName(copies.select("host", "at", "html").dropDuplicates(["host", "at"])).drop("at")


PARTS = "host string, key long, part binary"


def page_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, key (of the shape), part (pages and nodes) for each host and shape of a batch."""
    for batch in batches:
        held: dict[str, list] = {}
        for name, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held.setdefault(name, []).append((1, fold(page_nodes(page.as_py()))))
        rows = [(name, xxhash.xxh3_64_intdigest(shape.encode("utf-8", "surrogatepass")) >> 1, part) for name, parts in held.items() for shape, part in by_shape(parts).items()]
        yield part_batch(rows)


def part_batch(rows: list[tuple[str, int, tuple[int, list[Node]]]]) -> pa.RecordBatch:
    columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([pickle.dumps(r[2]) for r in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["host", "key", "part"])


def join_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, group, part in order of (host, group, key) to one row a group: parts of one key merge if they are of one
    shape, the others are aligned, one at a time, so memory holds one wrapper."""
    now, key, same, whole = None, None, None, None

    def closed() -> tuple[int, list[Node]] | None:
        return joined(x for x in (whole, same) if x)

    for batch in batches:
        out = []
        for name, group, k, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, nodes = pickle.loads(raw)
            if (name, group) != now:
                if now:
                    out.append((*now, closed()))
                now, key, same, whole = (name, group), k, (n, nodes), None
            elif k == key and [x.shape for x in nodes] == [x.shape for x in same[1]]:
                same = (same[0] + n, [merge(x, y) for x, y in zip(same[1], nodes, strict=True)])
            else:
                whole, key, same = closed(), k, (n, nodes)
        yield part_batch(out)
    if now:
        yield part_batch([(*now, closed())])


def wrappers(space: Workspace, pages: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """host and the summary of its wrapper as JSON, for hosts of two different pages or more."""
    now, k = space.keep(different(pages, space).mapInArrow(page_parts, PARTS), "parts-0"), 0
    while True:
        # Groups follow from a host's different shapes alone, not from how rows fell into batches.
        per = space.keep(now.groupBy("host").agg(F.countDistinct("key").alias("n"), F.count("*").alias("rows")).where("rows > 1"), f"per-{k}")
        if per.isEmpty():
            break
        total = per.agg(F.sum("rows")).first()[0]
        several = lookup(now, per.select("host", F.ceil(F.col("n") / fan_in).alias("groups"), "rows"), ["host"], "rows", total, "left")
        dealt = several.select("host", F.pmod(F.xxhash64("key"), F.coalesce("groups", F.lit(1))).alias("group"), "key", "part")
        dealt = dealt.repartition("host", "group").sortWithinPartitions("host", "group", "key")
        k += 1
        now = space.keep(dealt.mapInArrow(join_groups, PARTS), f"parts-{k}")
        space.drop(f"parts-{k - 1}")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(name, *pickle.loads(raw.as_py())) for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            rows = [(name, json.dumps(summary(nodes))) for name, n, nodes in found if n > 1]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["host", "learned"])

    return now.select("host", "part").mapInArrow(fit, "host string, learned string")


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, by_wrapper (whether the host's wrapper decided) for each row of pages."""
    pages = pages.select("page_id", "url", "html")
    space = Workspace(spark, "wrappers")
    learned = space.keep(wrappers(space, pages), "learned")
    size = learned.agg(F.sum(F.octet_length("learned") + F.octet_length("host"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, dict] = {}
        for batch in batches:
            found = []
            for page, raw in zip(batch.column(2), batch.column(3), strict=True):
                raw = raw.as_py()
                if raw is not None and raw not in parsed:
                    if len(parsed) > 1000:
                        parsed.clear()
                    parsed[raw] = json.loads(raw)
                    parsed[raw]["template"] = {p: set(v) for p, v in parsed[raw]["template"].items()}
                found.append(decide(page.as_py(), parsed.get(raw)))
            texts = [t for t, _ in found]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array([w for _, w in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "by_wrapper"])

    placed = pages.withColumn("host", host(F.col("url")))
    if size <= WRAPPER_BYTES:
        placed = placed.join(F.broadcast(learned), "host", "left")
    else:  # hot hosts' wrappers are few, so they are broadcast all the same, and no such host's pages meet in a task
        per = space.keep(placed.groupBy("host").agg(F.count("*").alias("_n")), "hosts")
        one = learned.join(per, "host")
        placed = lookup(placed, one, ["host"], "_n", per.agg(F.sum("_n")).first()[0] or 0, "left")
    return placed.select(F.col("page_id").cast("long"), "url", "html", "learned").mapInArrow(run, "page_id long, url string, text string, n_chars long, by_wrapper boolean")


def decided_by(extracted: DataFrame) -> DataFrame:
    """by_wrapper and pages: how many pages' main text a wrapper found, and how many went by their article element."""
    return extracted.groupBy("by_wrapper").agg(F.count("*").alias("pages"))
