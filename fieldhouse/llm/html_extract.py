"""Main text from HTML by wrappers inferred per host (operator 3).

A page is read into nested elements; an element's label is its name and, where its class, id or role says so, its
part (boilerplate or content). A host's wrapper is a union-free regular expression over labels: pages are
aligned one after another, child list by child list; where they differ, the elements that only one has become
optional, squares of neighbours become repeated groups, and text becomes a slot. Wrappers of the pages of one task,
then of groups of tasks, then of a host are aligned in the same way, so all pages count and no task gets a host whole.

The finished wrapper says for each slot whether it is of an article, of a main part, of a content part or of the
element that dominates the text, boilerplate inside aside; slots that are alike on all of several different pages or
hold little but links do not count for the last. Each page is aligned to its host's wrapper once more and gives the
text of the first of these kinds that it has itself; a page without any gives what dominates its own text, so pages
of one host may follow several templates.

Blocks end at block-level elements; character references are decoded, white space in a block becomes one space,
blocks are joined by an empty line.

Nulls, ties and odd rows: null or empty html gives the empty text; pages without a host share one wrapper; broken
markup is closed as browsers do, and as there, elements nested over ``DEPTH`` deep are read as if at that depth; rows that
repeat are extracted each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import json
import re
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, filled, schema_of, slices
from .url_filter import _host

DEPTH = 512  # as in browsers
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "template"}
_RAW_END = {n: re.compile(rf"</{n}[\s/>]", re.I) for n in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: start tag -> open elements it closes, and the elements that such closing does not cross
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_BAD_NAMES = set("nav footer aside form script style noscript template iframe button select textarea svg canvas dialog menu head title object audio video map".split())
_BAD_WORDS = set(
    "nav navigation navbar menu sidebar aside footer ad ads advert advertisement adverts banner promo promotion sponsor sponsored cookie cookies consent notice notification alert gdpr "
    "newsletter subscribe subscription comment comments reply replies respond disqus share sharing social related recommended breadcrumb breadcrumbs popup modal overlay widget login signup search toolbar pagination pager masthead skip".split()
)
#: words that say nothing beside a word above; a name with any other word, such as "related-work", is no sign
_PLAIN_WORDS = set(
    "area bar block body bottom box button card center col column container content fixed footer form global group head header inner item items js large left link links list main "
    "module off on outer page panel post posts row section site slot small sticky sub text title top unit wide wrap wrapper right".split()
)
_GOOD_WORDS = set("article content main post entry story body".split())

#: kinds of slots, in the order in which a page tries them; a USABLE one is of no boilerplate and not dull
ARTICLE, MAIN, CONTENT, DOMINANT, USABLE = 1, 2, 4, 8, 16
ALIKE = 5

Node = list  # [label, n, repeated, children, chars, link_chars, least, most]; a slot also has up to ALIKE hashes of pages


def _label(name: str, attrs: str) -> str:
    if name in _BAD_NAMES:
        return name + "-"
    if attrs and name not in ("body", "html", "article", "main"):
        names = [{w.lower() for w in _WORD.findall(x)} for m in _NAMED.finditer(attrs) for x in (m[1] or m[2] or m[3] or "").split()]
        if any(words & _BAD_WORDS and words <= _BAD_WORDS | _PLAIN_WORDS for words in names):
            return name + "-"
        if any(words & _GOOD_WORDS for words in names):
            return name + "+"
    return name


class Element:
    __slots__ = ("name", "label", "children")

    def __init__(self, name: str, label: str):
        self.name, self.label, self.children = name, label, []  # children: elements and texts


def read(page: str) -> Element:
    """The page as nested elements; scripts, styles and other raw contents are dropped."""
    root = Element("", "")
    stack = [root]
    at, end = 0, len(page)

    def text(t: str) -> None:
        if t:
            stack[-1].children.append(_html.unescape(t))

    def close(names: set[str], stop: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                del stack[i:]
                return
            if stack[i].name in stop:
                return

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, attrs = name.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            close({name}, {"td", "th"} if name not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body", "html") else set())
            continue
        if name in _RAW:
            tail = _RAW_END[name].search(page, at)
            at = tail.start() if tail else end
            if tail:
                gt = page.find(">", at)
                at = gt + 1 if gt >= 0 else end
            continue
        if name in _CLOSES:
            close(*_CLOSES[name])
        if name in _BLOCK:
            close({"p"}, {"table", "td", "th", "button", "div", "article", "section", "li"} if name != "p" else {"table", "td", "th", "button"})
        if name in ("html", "body") and any(e.name == name for e in stack):
            continue
        e = Element(name, _label(name, attrs))
        stack[-1].children.append(e)
        if name not in _VOID and not attrs.endswith("/") and len(stack) < DEPTH:
            stack.append(e)
        elif name not in _VOID and not attrs.endswith("/"):
            e.name = name  # too deep: what follows joins the element above
    return root


# ---------------------------------------------------------------- wrappers


def _text_node(t: str, linked: bool, page: int) -> Node:
    h = xxhash.xxh32_intdigest(t.strip().encode("utf-8", "replace"))
    return ["#", 1, False, [], len(t), len(t) if linked else 0, h, h, [page]]


def _contents(e: Element) -> int:
    """A hash of the page's texts; pages with equal texts are one page for the rule on slots that are alike."""
    h, todo = xxhash.xxh64(), [e]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, str):
                h.update(c.strip().encode("utf-8", "replace") + b"\0")
            else:
                todo.append(c)
    return h.intdigest()


def shape(e: Element, linked: bool = False, page: int | None = None) -> Node:
    """The expression of one element: squares of neighbours collapsed, texts as slots."""
    linked = linked or e.name == "a"
    page = _contents(e) if page is None else page
    kids: list[Node] = []
    for c in e.children:
        if isinstance(c, str):
            if not c.isspace():
                if kids and kids[-1][0] == "#":
                    _add(kids[-1], _text_node(c, linked, page))
                else:
                    kids.append(_text_node(c, linked, page))
        else:
            kids.append(shape(c, linked, page))
            _collapse(kids)
    return [e.label, 1, False, kids, 0, 0, 0, 0]


def _collapse(kids: list[Node]) -> None:
    """Merge a square (a sequence of labels twice in a row) at the end of the list into a repeated group."""
    for k in range(1, min(4, len(kids) // 2) + 1):
        if all(kids[-i][0] == kids[-i - k][0] for i in range(1, k + 1)):
            last = kids[-k:]
            del kids[-k:]
            for old, new in zip(kids[-k:], last, strict=True):
                _add(old, new)
                old[2] = True
            return


def _add(a: Node, b: Node) -> None:
    """Align b into a (equal labels)."""
    if a[0] == "#":
        a[6], a[7] = min(a[6], b[6]), max(a[7], b[7])
        if len(a[8]) < ALIKE:
            a[8] = sorted({*a[8], *b[8]})[:ALIKE]
    a[1] += b[1]
    a[2] = a[2] or b[2]
    a[4] += b[4]
    a[5] += b[5]
    a[3] = _merge(a[3], b[3])


def common(xs: list[str], ys: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, for lists of any length: a row of its table is one integer, a bit for each of ``ys``
    that is 0 where the length grows."""
    n, m = len(xs), len(ys)
    head = 0
    while head < min(n, m) and xs[head] == ys[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and xs[n - 1 - tail] == ys[m - 1 - tail]:
        tail += 1
    mid, other = xs[head : n - tail], ys[head : m - tail]
    where: dict[str, int] = {}
    for j, y in enumerate(other):
        where[y] = where.get(y, 0) | 1 << j
    full = (1 << len(other)) - 1
    rows = [full]
    for x in mid:
        row, hit = rows[-1], where.get(x, 0)
        rows.append(((row + (row & hit)) | (row & ~hit)) & full)
    pairs = []
    i, j = len(mid), len(other)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((head + i, head + j))
    return [*((i, i) for i in range(head)), *reversed(pairs), *((n - tail + i, m - tail + i) for i in range(tail))]


def _merge(xs: list[Node], ys: list[Node]) -> list[Node]:
    if not ys:
        return xs
    if not xs:
        return ys
    lx, ly = [x[0] for x in xs], [y[0] for y in ys]
    if lx == ly:
        for x, y in zip(xs, ys, strict=True):
            _add(x, y)
        return xs
    n, m = len(lx), len(ly)
    pairs = common(lx, ly)
    out: list[Node] = []
    i = j = 0
    for pi, pj in [*pairs, (n, m)]:
        for z in [*xs[i:pi], *ys[j:pj]]:
            out.append(z)
            _collapse(out)
        if pi < n:
            _add(xs[pi], ys[pj])
            out.append(xs[pi])
            _collapse(out)
        i, j = pi + 1, pj + 1
    return out


def expression(w: Node) -> str:
    """The wrapper as a regular expression over tags, # for a text slot."""
    parts = []
    for c in w[3]:
        inner = "#" if c[0] == "#" else f"<{c[0].rstrip('+-')}>{expression(c)}</{c[0].rstrip('+-')}>"
        optional = c[1] < w[1]
        parts.append(f"({inner})" + ("*" if optional else "+") if c[2] else f"({inner})?" if optional else inner)
    return "".join(parts)


def _find(w: Node, want) -> list[Node]:
    """The outermost nodes for which ``want`` holds, boilerplate aside."""
    out = []
    for c in w[3]:
        if c[0].endswith("-"):
            continue
        out += [c] if want(c[0]) else _find(c, want)
    return out


def _mass(w: Node) -> int:
    """Text outside links and boilerplate."""
    return w[4] - w[5] if w[0] == "#" else sum(_mass(c) for c in w[3] if not c[0].endswith("-"))


def decide(w: Node) -> list:
    """The wrapper as [label, children], a slot as the sum of its kinds."""
    best = w
    while True:
        kids = [c for c in best[3] if c[0] != "#" and not c[0].endswith("-")]
        top = max(kids, key=_mass, default=None)
        if top is None or top[2] or _mass(top) < 0.6 * max(1, _mass(best)) or top[0] in ("p", "b", "span"):
            break
        best = top
    chosen = {id(w): USABLE}
    chosen[id(best)] = chosen.get(id(best), 0) | DOMINANT
    for kind, want in ((ARTICLE, "article".__eq__), (MAIN, "main".__eq__), (CONTENT, lambda x: x.endswith("+"))):
        marked = _find(w, want)
        if any(_mass(m) for m in marked):
            for m in marked:
                chosen[id(m)] = chosen.get(id(m), 0) | kind

    def walk(c: Node, inside: int) -> object:
        inside = 0 if c[0].endswith("-") else inside | chosen.get(id(c), 0)
        if c[0] == "#":
            dull = c[5] > 0.9 * c[4] or (len(c[8]) >= ALIKE and c[6] == c[7])
            return inside & ~(DOMINANT | USABLE) if dull else inside
        return [c[0], [walk(k, inside) for k in c[3]]]

    return walk(w, 0)  # type: ignore[return-value]


def _slot(kids: list, at: int) -> int | None:
    return next((i for i in [*range(at, len(kids)), *range(at)] if isinstance(kids[i], int)), None)


def _same(kids: list, at: int, label: str) -> int | None:
    return next((i for i in [*range(at, len(kids)), *range(at)] if not isinstance(kids[i], int) and kids[i][0] == label), None)


def _dominant(page: Element, kids: list) -> Element:
    """The element that dominates the page's own text in usable slots."""
    mass: dict[int, int] = {}

    def weigh(e: Element, kids: list, linked: bool) -> int:
        at = total = 0
        linked = linked or e.name == "a"
        for c in e.children:
            k = _slot(kids, at) if isinstance(c, str) else _same(kids, at, c.label)
            if k is None or (isinstance(c, str) and c.isspace()):
                continue
            at = k
            if not isinstance(c, str):
                total += weigh(c, kids[k][1], linked)
            elif kids[k] & USABLE and not linked:
                total += len(c)
        mass[id(e)] = total
        return total

    weigh(page, kids, False)
    best = page
    while True:
        inner = [c for c in best.children if not isinstance(c, str) and not c.label.endswith("-")]
        top = max(inner, key=lambda c: mass.get(id(c), 0), default=None)
        if top is None or mass.get(id(top), 0) < 0.6 * max(1, mass[id(best)]) or top.name in ("p", "b", "span"):
            return best
        if sum(c.label == top.label for c in inner) > 1:
            return best
        best = top


def extract(page: Element, wrapper: list | None) -> str:
    """Text of the page's slots of the first kind that it has."""
    kids = wrapper[1] if wrapper else []
    for kind in (ARTICLE, MAIN, CONTENT, DOMINANT):
        text = _taken(page, kids, kind)
        if text:
            return text
    return _taken(page, kids, USABLE, _dominant(page, kids)) if kids else ""


def _taken(page: Element, kids: list, kind: int, within: Element | None = None) -> str:
    """Text of the page's slots of one kind, of those in the element ``within`` if one is given."""
    blocks: list[str] = []
    open_: list[str] = []

    def end() -> None:
        if open_:
            t = " ".join("".join(open_).split())
            if t:
                blocks.append(t)
            open_.clear()

    def walk(e: Element, kids: list, inside: bool) -> None:
        at = 0
        inside = inside or e is within
        for c in e.children:
            if isinstance(c, str):
                if c.isspace():
                    if open_:
                        open_.append(" ")
                    continue
                k = _slot(kids, at)
                if k is not None:
                    at = k
                    if inside and kids[k] & kind:
                        open_.append(c)
                continue
            block = c.name in _BLOCK
            if block:
                end()
            elif c.name == "br" and open_:
                open_.append(" ")
            k = _same(kids, at, c.label)
            if k is not None:
                at = k
                walk(c, kids[k][1], inside)
            if block:
                end()

    walk(page, kids, within is None)
    end()
    return "\n\n".join(blocks)


# ---------------------------------------------------------------- jobs


def deep_pages() -> None:
    """Room for functions that call themselves once or twice for each of ``DEPTH`` levels."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10 * DEPTH))


def _infer():
    schema = schema_of("host string, part int, wrapper string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deep_pages()
        found: dict[str, Node] = {}
        part = TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            b = pa.record_batch([pa.array(list(found), pa.string()), pa.array([part] * len(found), pa.int32()), pa.array([json.dumps(w) for w in found.values()], pa.string())], schema=schema)
            found.clear()
            return b

        for b in slices(batches, "_html"):
            for h, t in zip(b.column("host").to_pylist(), filled(b, "_html").to_pylist(), strict=True):
                s = shape(read(t))
                if h in found:
                    _add(found[h], s)
                else:
                    found[h] = s
            if len(found) > 10_000:
                yield out()
        if found:
            yield out()

    return run


def _aligned(pdf: pd.DataFrame) -> pd.DataFrame:
    deep_pages()
    ws = [json.loads(w) for w in sorted(pdf["wrapper"])]
    for w in ws[1:]:
        _add(ws[0], w)
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "part": [0], "wrapper": [json.dumps(ws[0])]})


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, part, wrapper as JSON) from rows with host and _html."""
    ddl = "host string, part int, wrapper string"
    part = pages.select("host", "_html").mapInArrow(_infer(), ddl)
    part = part.groupBy("host", F.pmod("part", F.lit(64)).alias("group")).applyInPandas(_aligned, ddl)
    return part.groupBy("host").applyInPandas(_aligned, ddl)


def _extracted(ddl: str):
    schema = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deep_pages()
        decided: dict[str, list] = {}
        for b in slices(batches, "_html"):
            texts = []
            for w, t in zip(b.column("wrapper").to_pylist(), filled(b, "_html").to_pylist(), strict=True):
                if w not in decided:
                    if len(decided) > 1000:
                        decided.clear()
                    decided[w] = decide(json.loads(w)) if w else ["", []]
                texts.append(extract(read(t), decided[w]))
            yield pa.record_batch([b.column("_page"), b.column("_url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return run


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id_col, url_col, text, n_chars."""
    scratch = Scratch(pages.sparkSession, "html")
    d = pages.select(F.col(id_col).cast("long").alias("_page"), F.col(url_col).alias("_url"), F.coalesce(_host(F.col(url_col)), F.lit("")).alias("host"), F.col(html_col).alias("_html"))
    known = scratch.write(wrappers(d), "wrappers").select(F.col("host"), "wrapper")
    ddl = "_page long, _url string, text string, n_chars long"
    out = d.join(known, "host", "left").select("_page", "_url", "_html", "wrapper").mapInArrow(_extracted(ddl), ddl)
    return out.select(F.col("_page").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
