"""HTML main text by wrapper induction over the pages of a host.

First pass: the DOM trees of a host's pages are aligned by simple tree matching with the host's pilot, its page of the
least id. Nodes that match with equal text are counted by (host, path, text hash); those with the same text on SHARE
of the host's different pages or more (NAMED where an article or main element holds them), SUPPORT at least, are the
host's template. What varies is summed for every container: the place that holds MOST of a host's varying text is its
content slot. Names and tags only vote: text in elements whose every name says navigation, notice, advert, form,
comment and so on counts nothing, text in article or main elements FAVOUR times. Second pass: a page's text is what its
content slot holds, with first-level headings of the page, without template nodes and excluded elements. An element
that holds most of the varying text is only excluded if all words of a name say so.

Trees travel as small outlines, one page once; copies of a page count once. Counts are summed on the map side and by
key; a host's template is a few rows.

Defined cases: null html is empty and gives an empty text; pages without a host (null or odd url) share one empty host;
a host's only page has no constants; a page without text in the slot gives what else varies; a named article that is
constant as a whole stays; tags left open end where HTML ends them; a page of nothing but excluded parts gives an empty
text; repeated rows are pages of their own; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import html
import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, text_of

SHARE = 0.6
NAMED = 0.9
SUPPORT = 3
MOST = 0.9
FAVOUR = 20
_FLUSH = 100_000
_DEPTH = 80

_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>)""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_GONE = frozenset("script style noscript template nav aside footer form button select option textarea label input fieldset iframe object svg canvas head title dialog menu audio video figcaption".split()) - {"figcaption"}
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "li", "dd", "dt", "legend", "summary", "figcaption"} | {"li", "dd", "dt"}
_SAME = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BOILER = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead comment comments "
    "reply replies disqus cookie cookies consent notice notices alert popup modal overlay share sharing social related recommended subscribe subscription newsletter signup login search widget "
    "pagination pager toolbar skip hidden gdpr paywall respond".split()
)
#: Words beside which a name still says nothing but what its other words say.
_PLAIN = frozenset("site page main global top bottom left right list section container wrapper wrap box block inner outer area item items content bar column col row".split())
_HOLDS = frozenset("#root html body div section article main center form fieldset table tbody tr td".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
_CONTENT = frozenset(("article", "main"))


class Node:
    """An element: its tag, what its names say, and its children (elements and texts).

    gone: excluded; weak: excluded unless it holds most of the text; kept: named content; sign: tag and names without numbers.
    """

    __slots__ = ("children", "gone", "kept", "sign", "tag", "weak")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.children = tag, []
        self.weak, self.kept, self.sign = False, tag in _CONTENT, tag
        self.gone = tag in _GONE
        if attributes and "=" in attributes or "hidden" in attributes:
            for name, value in _NAMES.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name in ("class", "id"):
                    self.sign += ("." if name == "class" else "#") + re.sub(r"[0-9/]+", "_", value)
                    if tag not in ("html", "body"):
                        self._named(value)
                elif name == "role":
                    self.gone |= value.lower() in _BOILER_ROLES
                    self.kept |= value.lower() in _CONTENT
                elif name == "itemprop":
                    self.kept |= value == "articleBody"
                elif name == "hidden" or value.lower() == "true":
                    self.gone = True

    def _named(self, value: str) -> None:
        for name in value.split():
            words = {w.lower() for w in _WORDS.findall(name)}
            if words & _BOILER:
                self.weak = True
                self.gone |= words <= _BOILER | _PLAIN


def parse(page: str) -> Node:
    """The tree of a page; never fails. Elements that HTML ends by itself are ended, open ones end with the page."""
    root = Node("#root")
    stack = [root]
    at, end = 0, len(page)
    search = _TAG.search
    while at < end:
        m = search(page, at)
        if m is None:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if any(n.tag == name for n in stack):
                while stack.pop().tag != name:
                    pass
            elif name == "p":
                stack[-1].children.append(Node("p"))
            continue
        if name in _CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in _BLOCK:
                    break
        if name in _SAME:
            ends, scope = _SAME[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    del stack[i:]
                elif stack[i].tag in scope:
                    break
        node = Node(name, m[3])
        if node.kept or name == "h1":
            for n in stack:  # a form around a page's content is no form of the page
                n.gone, n.weak = n.gone and n.tag != "form", n.weak or n.tag == "form"
        stack[-1].children.append(node)
        if name in _VOID or m[3].endswith("/") and name not in _BLOCK:
            continue
        if name in _RAW:
            close = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            stop = close.start() if close else end
            node.children.append(page[at:stop])
            at = page.find(">", stop) + 1 if close and page.find(">", stop) >= 0 else end
            continue
        stack.append(node)
    return root


def squeeze(text: str) -> str:
    """Character references decoded, white space as single spaces, trimmed."""
    return " ".join(html.unescape(text).split())


def _numbered(children: Iterable, sign: Callable[[object], str]) -> Iterator[tuple[object, str]]:
    """Elements with their sign and number among those of the same sign."""
    seen: dict[str, int] = defaultdict(int)
    for c in children:
        name = sign(c)
        seen[name] += 1
        yield c, f"{name}:{seen[name]}"


def blocks(root: Node, most: frozenset[str] = frozenset()) -> Iterator[tuple[str, str, bool, bool, str]]:
    """The blocks of a tree in page order: path, text, whether an excluded element holds it, whether a named content element does, place (the path with numbers). most: places that hold most of the text."""
    found: list[tuple[str, str, bool, bool, str]] = []
    held: list[str] = []
    # what remains to be done; a state in place of a node ends a block
    state: tuple = ("", False, False, "")
    work: list[tuple] = [(root, "#root:1", state)]

    def flush() -> None:
        text = squeeze("".join(held))
        held.clear()
        if text:
            found.append((state[0], text, *state[1:]))

    while work:
        node, number, over = work.pop()
        if node is None:  # the end of a block or of an excluded inline element
            flush()
            state = over
            continue
        if isinstance(node, str):
            held.append(node)
            continue
        if node.tag in ("br", "hr", "wbr"):
            held.append("" if node.tag == "wbr" else "\n")
            if node.tag == "br":
                continue
        path, gone, kept, place = over
        here = gone or node.gone or node.tag == "header" and not kept or node.weak and f"{place}/{number}" not in most
        inside = kept or node.kept
        if node.tag in _BLOCK or here != gone or node.tag == "#root":
            flush()
            work.append((None, "", state))
            state = over = (f"{path}/{node.sign}", here, inside, f"{place}/{number}")
        else:
            over = (path, here, inside, place)
        elements = _numbered((c for c in node.children if isinstance(c, Node) and c.tag in _BLOCK), lambda c: c.sign)
        numbers = {id(c): n for c, n in elements}
        work.extend((c, numbers.get(id(c), getattr(c, "sign", "")), over) for c in reversed(node.children))
    flush()
    return iter(found)


def outline(root: Node) -> list:
    """The tree for matching: [sign, text hash or 0, weight of the text, children]."""

    def make(node: Node, kept: bool, gone: bool, depth: int) -> list:
        kept, gone = kept or node.kept, gone or node.gone or node.tag == "header" and not kept
        if node.tag in ("head", "script", "style"):
            return [node.sign, 0, 0, []]
        own = squeeze("".join(_text(node) if depth >= _DEPTH else _own(node)))
        children = [] if depth >= _DEPTH else [make(c, kept, gone, depth + 1) for c in node.children if isinstance(c, Node) and c.tag in _BLOCK]
        return [node.sign, xxhash.xxh64_intdigest(own, 0) >> 1 if own else 0, _weight(own, gone, kept), children]

    return make(root, False, False, 0)


def _weight(text: str, gone: bool, kept: bool) -> int:
    return 0 if gone else len(text) * (FAVOUR if kept else 1)


def held_text(tree: list) -> dict[str, int]:
    """The weight of the text of every container of an outline, by place."""
    sums: dict[str, int] = defaultdict(int)

    def add(node: list, place: str) -> int:
        total = node[2] + sum(add(c, f"{place}/{number}") for c, number in _numbered(node[3], lambda c: c[0]))
        if node[0] == "#root" or re.split("[.#]", node[0], maxsplit=1)[0] in _HOLDS:
            sums[place] += total
        return total

    add(tree, "/#root:1")
    return sums


def _placed(tree: list, path: str = "", place: str = "/#root:1") -> tuple:
    """An outline as nested (sign, path, text hash, children, weight, place)."""
    path = f"{path}/{tree[0]}"
    return tree[0], path, tree[1], tuple(_placed(c, path, f"{place}/{n}") for c, n in _numbered(tree[3], lambda c: c[0])), tree[2], place


def _own(node: Node) -> Iterator[str]:
    """Texts of a node and of what it holds that makes no block."""
    work = list(reversed(node.children))
    while work:
        c = work.pop()
        if isinstance(c, str):
            yield c
        elif c.tag not in _BLOCK and not (c.gone or c.weak):
            yield "\n" if c.tag == "br" else ""
            work.extend(reversed(c.children))


def _text(node: Node) -> Iterator[str]:
    work = list(reversed(node.children))
    while work:
        c = work.pop()
        if isinstance(c, str):
            yield c
        else:
            work.extend(reversed(c.children))


def align(a: tuple, b: tuple) -> tuple[int, list[tuple[tuple, tuple]]]:
    """Simple tree matching of two outlines: the size of the largest order-preserving match and its pairs."""
    if a[0] != b[0]:
        return 0, []
    left, right = a[3], b[3]
    if not left or not right:
        return 1, [(a, b)]
    m, n = len(left), len(right)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    pairs: dict[tuple[int, int], tuple[int, list]] = {}
    for i in range(1, m + 1):
        row, above = best[i], best[i - 1]
        for j in range(1, n + 1):
            if left[i - 1][0] == right[j - 1][0]:
                pairs[i, j] = got = align(left[i - 1], right[j - 1])
                row[j] = max(above[j], row[j - 1], above[j - 1] + got[0])
            else:
                row[j] = max(above[j], row[j - 1])
    matched: list[tuple[tuple, tuple]] = []
    i, j = m, n
    while i and j:
        got = pairs.get((i, j))
        if got and best[i][j] == best[i - 1][j - 1] + got[0]:
            matched += got[1]
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[m][n] + 1, [(a, b), *matched]


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trees = [json.dumps(outline(parse(page.as_py())), separators=(",", ":")).encode() for page in batch.column("_html")]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page_id"), pa.array(trees, pa.binary()), pa.array([xxhash.xxh64_intdigest(t, 7) >> 1 for t in trees], pa.int64())], names=["host", "page_id", "tree", "print"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, path, place, hash, pages, weight: how often matched nodes had this text; an empty path counts the host's pages, hash -1 is what a container holds."""
    sums: dict[tuple[str, str, str, int], list[int]] = defaultdict(lambda: [0, 0])
    name, pilot = None, ()

    def put(key: tuple[str, str, str, int], weight: int) -> None:
        held = sums[key]
        held[0] += 1
        held[1] += weight

    def flush() -> pa.RecordBatch:
        kinds = [pa.string()] * 3 + [pa.int64()] * 3
        rows = [(*k, *v) for k, v in sums.items()]
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in _COUNTS.split(", ")])
        sums.clear()
        return out

    for batch in batches:
        for host, tree, first in zip(batch.column("host").to_pylist(), batch.column("tree"), batch.column("pilot"), strict=True):
            if name != (first := first.as_py()):
                name, pilot = first, _placed(json.loads(first))
            tree = json.loads(tree.as_py())
            put((host, "", "", 0), 0)
            for place, weight in held_text(tree).items():
                put((host, "", place, -1), weight)
            for path, h, weight, place in {x[1:3] + x[4:] for a, x in align(pilot, _placed(tree))[1] if x[2] and a[2] == x[2]}:
                put((host, path, place, h), weight)
            if len(sums) >= _FLUSH:
                yield flush()
    yield flush()


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", host.alias("host"), text_of("html").alias("_html"))


_COUNTS = "host string, path string, place string, hash bigint, pages bigint, weight bigint"


def templates(pages: DataFrame, share: float = SHARE, support: int = SUPPORT) -> DataFrame:
    """Per host of pages (page_id, url, html): constants (hashes of path and text of its constant nodes) and most (the places that hold most of what varies)."""
    trees = _hosted(pages).select("host", "page_id", "_html").mapInArrow(_outlines, "host string, page_id bigint, tree binary, print bigint")
    trees = staged(trees.groupBy("host", "print").agg(F.min_by("tree", F.struct(F.col("page_id").isNull(), "page_id")).alias("tree"), F.min(F.struct(F.col("page_id").isNull(), "page_id")).alias("first")), "wrapper-outlines")
    # written, so that Spark broadcasts pilots only if they are few, and else splits what a hot host makes large
    pilots = staged(trees.groupBy("host").agg(F.min_by("tree", F.struct("first", "print")).alias("pilot")), "wrapper-pilots")
    sums = trees.join(pilots, "host").select("host", "tree", "pilot").mapInArrow(_counts, _COUNTS).groupBy("host", "path", "place", "hash").agg(F.sum("pages").alias("pages"), F.sum("weight").alias("weight"))
    sums = staged(sums, "wrapper-counts")
    total = sums.where("hash = 0").select("host", F.col("pages").alias("_all"))
    least = F.when(F.col("path").rlike(r"/(article|main)([.#/]|$)"), max(share, NAMED)).otherwise(share)
    often = sums.where("hash > 0").groupBy("host", "path", "hash").agg(F.sum("pages").alias("pages"), F.collect_list(F.struct("place", "weight")).alias("_at"))
    constant = often.where(F.col("pages") >= support).join(total, "host").where(F.col("pages") >= least * F.col("_all")).select("host", "path", "hash", "_at")
    above = F.expr("transform(sequence(2, size(split(place, '/'))), i -> array_join(slice(split(place, '/'), 1, i), '/'))")
    less = constant.select("host", F.inline("_at")).select("host", F.explode(above).alias("place"), "weight").groupBy("host", "place").agg(F.sum("weight").alias("_less"))
    slots = sums.where("hash = -1").join(less, ["host", "place"], "left").select("host", "place", (F.col("weight") - F.coalesce("_less", F.lit(0))).alias("varies"))
    whole = slots.where("place = '/#root:1'").select("host", F.col("varies").alias("_whole"))
    most = slots.join(whole, "host").where((F.col("_whole") > 0) & (F.col("varies") >= MOST * F.col("_whole"))).groupBy("host").agg(F.collect_set("place").alias("most"))
    constants = constant.groupBy("host").agg(F.collect_set(F.concat_ws("|", "path", F.col("hash").cast("string"))).alias("constants"))
    return total.select("host").join(constants, "host", "left").join(most, "host", "left")


def main_text(page: str, constants: frozenset[str] = frozenset(), most: frozenset[str] | None = None) -> str:
    """The main text of a page: its blocks joined by an empty line. most: as templates gives it; None: this page is its host's only one."""
    root = parse(page)
    if most is None:
        sums = held_text(outline(root))
        most = frozenset(p for p, n in sums.items() if n and n >= MOST * sums["/#root:1"])
    slot = max(most, key=len, default="")
    found = [b for b in blocks(root, most) if not b[2]]
    fresh = [b for b in found if f"{b[0]}|{xxhash.xxh64_intdigest(b[1], 0) >> 1}" not in constants]
    inside = lambda place: f"{place}/".startswith(f"{slot}/")
    if any(inside(b[4]) for b in fresh):
        out = [b for b in fresh if inside(b[4]) or re.search(r"/h1([.#][^/]*)?$", b[0])]
    else:
        out = [b for b in found if b[3]] or fresh
    return "\n\n".join(b[1] for b in out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py(), frozenset(known.as_py() or ()), frozenset(most.as_py() or ())) for page, known, most in zip(batch.column("_html"), batch.column("constants"), batch.column("most"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars."""
    known = staged(templates(pages), "wrapper-templates")
    rows = _hosted(pages).join(known.withColumnRenamed("host", "_host"), F.col("host") == F.col("_host"), "left")
    return rows.select("page_id", "url", "_html", "constants", "most").mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
