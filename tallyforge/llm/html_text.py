"""Main text of HTML pages by tag-path ratios.

A page is cut to text blocks; each has the path of the tags (with class) from the root to it. For every path of a page the
text lengths and the punctuation marks of its blocks are summed, and divided by the number of its blocks. Both ratios are laid
along the page's blocks, smoothed with a Gaussian over neighbouring blocks (of one container, or of containers one in the other), and fused: their product, times the weight of the
path, as a share of the page's largest. The weight holds what the markup says beside the text: <article> and <main> raise it,
a class, id or role that names an advert, a notice, a menu or comments makes it very small, and one that may mean such things
or not makes it smaller.

A path's container is its innermost division (<div>, <section>, <article>, table cell and the like). Containers have the mass
of their own paths, text length times ratio. A path is content if its ratio, or its container's mass as a share of the largest,
reaches ``threshold``: so short lines between paragraphs stay with them. A heading goes by its container with all that this
holds, since it stands above it. What a chosen container holds stays, short sections and tables too, unless a name below it
lowers its weight or most of it is links. All of this decides on every page; no tag or class alone makes text content.

Scripts, styles, navigation, headers and footers of the page, sidebars, forms, dialogs and hidden elements never count.

In a block, character references are decoded and white space is one blank; blocks are joined by an empty line. Every page is
its own unit of work; nothing is shuffled. The time grows with a page's length, whatever it holds: tags are found in one pass,
paths are numbers in a tree, and open elements are found by name. Cases: null, empty or contentless pages have the empty text;
unclosed and stray end tags are tolerated; a < that begins no tag is text; repeated rows are answered one by one.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Fixed values.
_RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object", "noembed", "noframes", "xmp")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
_NEVER = frozenset("nav aside form footer button select option dialog menu head fieldset input label optgroup datalist output progress meter canvas audio video".split())
_CONTAINERS = frozenset("html body div section article main center table tbody tr td".split())
_HEADINGS = frozenset("h1 h2 hgroup".split())
#: Weights of a path: in <article>, in <main>, under a name of what isn't content, under one that may be.
_WEIGHT = {"article": 6.0, "main": 6.0, "strong": 0.002, "weak": 0.3}
_P_CLOSERS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SELF_CLOSERS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": (), "tbody": ("thead", "tbody", "tr", "td", "th")}
_STRONG = re.compile(
    r"^(?:ads?|advert\w*|adsense|adslot|sponsor\w*|nav\w*|menu\w*|breadcrumb\w*|masthead|footer|sidebar\w*|widget\w*|comments?|commentlist|respond|disqus\w*|replies|reply|notice\w*|cookie\w*|consent\w*|gdpr|popup\w*|modal\w*|newsletter\w*|subscribe\w*|signup|login|pagination|pager|toolbar|contentinfo|complementary|dialog|tooltip)$",
    re.I,
)
_WEAK = re.compile(r"^(?:banner\w*|promo\w*|header|foot|side|related\w*|recommend\w*|share\w*|sharing|social\w*|overlay|search\w*|form|copyright|legal|disclaimer|skip|tags|alert\w*)$", re.I)
_NAME, _NAME_END, _MARK = re.compile(r"/?[a-zA-Z]"), re.compile(r"[\s/>]"), re.compile(r"[>\"']")
_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in _RAW}
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
_SPACE = re.compile(r"\s+")
_PUNCT = re.compile(r"[,.;:!?¡¿…。、，；：！？]")


class _Paths:
    """Paths of labels as numbers: each has its parent's; a parent's number is smaller. 0 is the page."""

    def __init__(self) -> None:
        self.parent, self.label, self._known = [0], [""], {}

    def under(self, parent: int, label: str) -> int:
        if (found := self._known.get((parent, label))) is None:
            found = self._known[parent, label] = len(self.parent)
            self.parent.append(parent)
            self.label.append(label)
        return found

    def spans(self) -> tuple[list[int], list[int]]:
        """First and last place of what each path holds, in an order in which that is one stretch."""
        n = len(self.parent)
        size = [1] * n
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]
        first, used = [0] * n, [1] * n
        for i in range(1, n):
            up = self.parent[i]
            first[i] = first[up] + used[up]
            used[up] += size[i]
        return first, [a + b - 1 for a, b in zip(first, size, strict=True)]


class _Element:
    __slots__ = ("name", "never", "inside", "path", "container", "weight")

    def __init__(self, name: str, attrs: str, parent: _Element | None, paths: _Paths):
        found = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTR.finditer(attrs)} if attrs.strip() else {}
        hints = " ".join(found.get(k, "") for k in ("class", "id", "role")).split() if found else []
        inside = parent.inside if parent else ""
        never = name in _NEVER or (name == "header" and not inside)
        if found:
            never = never or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        self.name = name
        self.never = never or bool(parent and parent.never)
        self.inside = "article" if "article" in (inside, name) else "main" if "main" in (inside, name) else ""
        self.weight = parent.weight if parent else 1.0
        if self.inside != inside:
            self.weight *= _WEIGHT[self.inside] / _WEIGHT.get(inside, 1.0)
        label = name + "".join("." + h for h in sorted(found.get("class", "").split())) if found else name
        if hints and name not in ("body", "html", "main"):
            names = [p for h in hints for p in (h, *re.split(r"[-_]", h))]
            if kind := "strong" if any(map(_STRONG.match, names)) else "weak" if any(map(_WEAK.match, names)) else "":
                self.weight *= _WEIGHT[kind]
                label += f"!{kind}"  # an id or role parts paths too, if it says as much
        self.path = paths.under(parent.path if parent else 0, label)
        self.container = self.path if name in _CONTAINERS else parent.container if parent else 0


def tags(page: str) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, name (with / for an end tag; ! for a comment or declaration, [ for character data) and attributes of each tag. A tag
    ends at the first > outside of quotes; one that has none is text. Where a search has failed or will end is kept, so that no
    stretch is searched twice from two beginnings."""
    n, last, at = len(page), page.rfind(">"), 0
    name_end = mark = -1  # the next end of a name, and the next mark, from where they were looked for last
    looked_name = looked_mark = 0
    failed: set[int] = set()  # quotes outside of any other that open and are never closed on the way to a >
    while (i := page.find("<", at)) >= 0:
        at = i + 1
        if page.startswith("!--", at):
            end = page.find("-->", at + 3)
            at = n if end < 0 else end + 3
            yield i, at, "!", ""
        elif page.startswith("![CDATA[", at):
            end = page.find("]]>", at + 8)
            yield i, (n if end < 0 else end + 3), "[", page[at + 8 : n if end < 0 else end]
            at = n if end < 0 else end + 3
        elif page.startswith(("!", "?"), at):
            at = n if i > last else page.find(">", at) + 1
            yield i, at, "!", ""
        elif i < last and _NAME.match(page, at):
            if not looked_name <= at + 1 <= name_end:
                m = _NAME_END.search(page, at + 1 + (page[at] == "/"))
                looked_name, name_end = at + 1, m.start() if m else n
            seen, pos, found = [], name_end, -1
            while True:
                if not looked_mark <= pos <= mark:
                    m = _MARK.search(page, pos)
                    looked_mark, mark = pos, m.start() if m else n
                if mark >= n or mark in failed:
                    break
                if page[mark] == ">":
                    found = mark
                    break
                seen.append(mark)
                close = page.find(page[mark], mark + 1)
                if close < 0:
                    break
                pos = close + 1
            if found < 0:
                failed.update(seen)
                continue
            at = found + 1
            yield i, at, page[i + 1 : name_end].lower(), page[name_end:found]


def blocks(page: str, paths: _Paths) -> list[tuple[_Element | None, str, float]]:
    """The page's text blocks in order: the element that the text begins in, the text, and the share of it within links."""
    stack: list[_Element] = []
    places: dict[str, list[int]] = defaultdict(list)  # of open elements in the stack, by name
    solid: list[int] = []  # of those that aren't inline
    out: list[tuple[_Element | None, str, float]] = []
    text: list[str] = []
    owner: _Element | None = None
    size = linked = 0

    def flush() -> None:
        nonlocal owner, size, linked
        if text:
            joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if joined:
                out.append((owner, joined, linked / max(size, 1)))
            text.clear()
        owner, size, linked = None, 0, 0

    def add(part: str) -> None:
        nonlocal owner, size, linked
        if part:
            blank = part.isspace()
            if owner is None and not blank:
                owner = stack[-1] if stack else None
            text.append(part)
            if not blank:
                size += len(part)
                linked += len(part) if places["a"] else 0

    def close(i: int) -> None:
        for e in reversed(stack[i:]):
            places[e.name].pop()
            if e.name not in _INLINE:
                solid.pop()
        del stack[i:]

    at, skip = 0, 0
    for start, end, name, attrs in tags(page):
        if start < skip:  # in a script or the like
            continue
        add(page[at:start])
        at = end
        if name == "[":
            add(html.escape(attrs))
        if name in ("[", "!"):
            continue
        if name.startswith("/"):
            name = name[1:]
            if name == "p" and not places["p"]:
                flush()
            i = places[name][-1] if places[name] else -1
            if i >= 0 and not (name in _INLINE and solid and solid[-1] > i):
                gone = stack[i:]
                if name not in _INLINE or any(e.never for e in gone) != bool(i and stack[i - 1].never) or any(e.name not in _INLINE for e in gone):
                    flush()
                close(i)
            continue
        if name in _RAW:
            m = _END[name].search(page, at, page.rfind(">") + 1) if at < len(page) else None
            at = skip = m.end() if m else len(page)
            continue
        if name == "br":
            add(" ")
            continue
        if name in _VOID:
            if name not in _INLINE:
                flush()
            continue
        if name in _P_CLOSERS or name in _SELF_CLOSERS:
            flush()
            closing = ("p",) if name in _P_CLOSERS else _SELF_CLOSERS[name]
            if solid and stack[solid[-1]].name in closing:
                close(solid[-1])
        elif name not in _INLINE:
            flush()
        parent = stack[-1] if stack else None
        element = _Element(name, attrs, parent, paths)
        if element.never and not (parent and parent.never):
            flush()
        if not attrs.endswith("/"):
            places[name].append(len(stack))
            if name not in _INLINE:
                solid.append(len(stack))
            stack.append(element)
    add(page[at:])
    flush()
    return out


def _holds(a: str, b: str) -> bool:
    """Whether one of two paths, written as /a/b, is or holds the other."""
    return a == b or f"{a}/".startswith(f"{b}/") or f"{b}/".startswith(f"{a}/")


def ratios(paths: list, texts: list[str], weights: list[float], containers: list, width: float = 1.0, nested: Callable = _holds) -> list[float]:
    """The fused, smoothed and weighted tag-path ratio of each block, as a share of the largest."""
    size, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for p, t in zip(paths, texts, strict=True):
        size[p] += len(t)
        marks[p] += len(_PUNCT.findall(t))
        count[p] += 1
    reach = math.ceil(2 * width)
    bell = [math.exp(-(i * i) / (2 * width * width)) for i in range(reach + 1)]

    def smooth(x: list[float]) -> list[float]:
        out = []
        for i in range(len(x)):
            near = [j for j in range(max(0, i - reach), min(len(x), i + reach + 1)) if nested(containers[i], containers[j])]
            total = sum(bell[abs(i - j)] for j in near)
            out.append(sum(bell[abs(i - j)] * x[j] for j in near) / total)
        return out

    lengths, points = smooth([size[p] / count[p] for p in paths]), smooth([(1 + marks[p]) / count[p] for p in paths])
    fused = [a * b * w for a, b, w in zip(lengths, points, weights, strict=True)]
    top = max(fused, default=1.0)
    return [x / top for x in fused]


#: More of a container's text than this within links: a list of links, not content.
_LINKS = 0.5


def main_text(page: str | None, threshold: float = 0.2) -> str:
    paths = _Paths()
    found = [x for x in blocks(page or "", paths) if not (x[0] and x[0].never)]
    first, last = paths.spans()
    keys = [(e.container, e.path, e.weight, e.name in _HEADINGS) if e else (0, 0, 1.0, False) for e, _, _ in found]
    of: dict[tuple, list[float]] = defaultdict(list)  # a path is in or out as a whole
    size: dict[tuple, int] = defaultdict(int)
    links: dict[tuple, float] = defaultdict(float)
    shares = ratios([k[1] for k in keys], [t for _, t, _ in found], [k[2] for k in keys], [k[0] for k in keys], nested=lambda a, b: first[a] <= first[b] <= last[a] or first[b] <= first[a] <= last[b])
    for k, (_, t, linked), r in zip(keys, found, shares, strict=True):
        of[k].append(r)
        size[k] += len(t)
        links[k] += len(t) * linked
    ratio = {k: sum(x) / len(x) for k, x in of.items()}
    mass = [0.0] * len(paths.parent)
    for k, r in ratio.items():
        mass[k[0]] += r * size[k]
    whole = mass.copy()  # a container's mass is also that of the containers around it
    for i in range(len(whole) - 1, 0, -1):
        whole[paths.parent[i]] += whole[i]
    most = max(mass, default=0.0) or 1.0
    up = paths.parent
    pages = {0, *(i for i in {k[0] for k in ratio} if up[up[i]] == 0 and paths.label[i].split(".")[0] in ("html", "body"))}
    share = {k: (whole if k[3] and k[0] not in pages else mass)[k[0]] / most for k in ratio}
    chosen = {k for k, r in ratio.items() if max(r, share[k]) >= threshold}
    # what chosen containers hold, in the order of places: the weight below which a name has spoken against it
    weight: dict[int, float] = {}
    for k in chosen:
        if k[0] not in pages and share[k] >= threshold:
            weight[k[0]] = min(weight.get(k[0], k[2]), k[2])
    held: dict[int, float | None] = {}
    own, linked = defaultdict(int), defaultdict(float)
    for k in ratio:
        own[k[0]] += size[k]
        linked[k[0]] += links[k]
    for i in range(len(up)):  # parents come first
        around = held.get(up[i]) if i else None
        held[i] = weight.get(i, around)
    chosen |= {k for k in ratio if held[k[0]] is not None and k[0] not in weight and k[2] >= held[k[0]] and linked[k[0]] <= _LINKS * own[k[0]]}
    return "\n\n".join(t for k, (_, t, _) in zip(keys, found, strict=True) if k in chosen)


def extract(df: DataFrame, page: str = "html") -> DataFrame:
    """df with main_text and n_chars in place of the page."""
    spark = df.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    others = df.drop(page)
    names = [common.free_name(others, x) for x in ("main_text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(page)
            texts = [main_text(x.as_py()) for x in batch.column(k)]
            columns = [c for i, c in enumerate(batch.columns) if i != k]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*(c for c in batch.schema.names if c != page), *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others.schema.fields)
    return df.mapInArrow(run, f"{schema + ', ' if schema else ''}`{names[0]}` string, `{names[1]}` bigint")


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(common.read(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumnRenamed("main_text", "text")
