"""HTML extraction: tag-path ratios.

The page is read once, as a sequence of text blocks, each with its root-to-leaf tag path (inline elements
leave no mark; class and id do).  Per path the text length outside links and the punctuation are
summed and divided by the number of its blocks.  The ratios are smoothed over the blocks in page
order with a Gaussian, fused with those of related paths by the share of their common prefix, and
paths above a share of the best are content.

Elements that never show text (scripts, menus, buttons and so on) are left out before.  Words of class, id
and role, and elements such as ``form``, only lower a ratio: what an element holds is judged by its own text and
punctuation a block, times a weight, against the best path outside all marks.  Inside the article (the ``article`` elements,
else ``main``) weights are mild, so a section stays whatever its name; a marked element outside an article that the page has goes;
one that holds the article, or
half of the sentences of a page without one, is a wrapper and stays.

Lists of like records that each begin with a byline are readers' comments if they stand by themselves after the text
and do not hold most of it; records among the article's own paragraphs are judged by their ratio, so interviews stay.
If all text is links, links count as text.

Null or empty html gives the empty text.  Unclosed elements, comments and tags are read as browsers
do, quotes count only where an attribute's value begins; time and memory are linear in the page.  Every row
stands alone, so repeated rows give equal results; nothing is cut short, and extra columns are ignored.
"""

from __future__ import annotations

import html as html_
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm.common import slices, table

# Elements by their part in a page.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NEVER = {"head", "nav", "menu", "footer", "aside", "button", "select", "noscript", "template", "svg", "canvas", "object", "dialog", "audio", "video", "option", "datalist", *RAW}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span",
    "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "img", "wbr",
}
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "dd", "dt", "figcaption"}
# Words of class and id that mark what is not the article: plain ones, and ones that articles may be about as well.
PLAIN_MARKS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disqus", "footer", "gdpr",
    "login", "masthead", "nav", "navbar", "newsletter", "pagination", "popup", "promo", "promoted", "sidebar", "signup", "sponsor", "sponsored", "subscribe", "tagcloud", "toolbar", "topbar", "widget",
}
OTHER_MARKS = {
    "alert", "banner", "disclaimer", "discussion", "discussions", "feedback", "menu", "modal", "navigation", "notice", "notices", "notification", "reader", "related", "replies", "respond", "responses",
    "reviews", "share", "sharing", "social", "talkback",
}
# Words before a mark that make it harmless.
HARMLESS = {"has", "no", "with", "without"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "alertdialog"}
# Which open elements a start tag closes.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr", "td", "th"}, "tfoot": {"tr", "td", "th", "tbody"}, "body": {"head"},
}
SCOPE = {"ul", "ol", "dl", "table", "select", "article", "main", "section", "div", "body", "html", "nav", "aside", "footer", "form", "blockquote"}
SHARE, RADIUS = 0.15, 2

PROSE = {"p", "blockquote", "pre"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
RECORD = {"div", "li", "article", "section", "dd", "tr", "details"}
#: Weights of a ratio inside and outside the article: a whole class or role, a whole plain id, part of a class, any other id, a form.
WHOLE, NAMED, PARTLY, LOOSE, FORM = (0.4, 0.05), (0.4, 0.05), (0.6, 0.15), (1.0, 0.3), (0.1, 0.05)
#: Share of the page's sentences that makes a marked element a wrapper, of the article's that makes records the article.
WRAPPER, MOST = 0.5, 0.5
SOFT = {"form": FORM, "label": FORM, "fieldset": LOOSE}
#: Longest byline.
BYLINE = 60

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+)|(/))")
_SHORT = re.compile(r"[^>=\"']*+>")
_ATTR = re.compile(r"""[\s/]*+(=?[^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)("|\Z)|'([^']*+)('|\Z)|([^\s>"'][^\s>]*+|(?=>))))?+""")
_WORD = re.compile(r"[a-z]+")
_PUNCT = re.compile(r"[.,;:!?…。，；：！？、]")
_END = re.compile(r"[.!?…。！？][\"'”’)\]]*$")


def _attributes(page: str, at: int) -> tuple[int, dict[str, str], bool]:
    """Where the tag ends (-1: never), its class, id and role, and whether it closes itself."""
    if m := _SHORT.match(page, at):
        return m.end(), {}, page.endswith("/", at, m.end() - 1)
    found: dict[str, str] = {}
    size, begin = len(page), at
    while True:
        m = _ATTR.match(page, at)
        at = m.end()
        name = m[1].lower()
        if name in ("class", "id", "role") and name not in found:
            found[name] = (m[2] or m[4] or m[6] or "").lower()
        if at >= size:
            return -1, found, False
        if page[at] == ">":
            return at + 1, found, at > begin and page[at - 1] == "/" and not m[6]


def _lower(a: tuple[float, float] | None, b: tuple[float, float] | None) -> tuple[float, float] | None:
    return b if a is None else a if b is None else (min(a[0], b[0]), min(a[1], b[1]))


def _marks(found: dict[str, str]) -> tuple[str, tuple[float, float] | None, bool]:
    """Label for the path, the weights (None: not marked) that class, id and role give an element, and whether they say header."""
    label, weight, head = "", WHOLE if found.get("role") in ROLES else None, False
    for name in ("class", "id"):
        if value := found.get(name):
            label += "." + value
            for token in value.split():
                words = _WORD.findall(token)
                head |= "header" in words
                for i, w in enumerate(words):
                    if (w in PLAIN_MARKS or w in OTHER_MARKS) and not (i and words[i - 1] in HARMLESS):
                        whole = len(words) == 1
                        by = (WHOLE if whole else PARTLY) if name == "class" else NAMED if whole and w in PLAIN_MARKS else LOOSE
                        weight = _lower(weight, by)
    return label, weight, head


@dataclass
class Page:
    """Blocks of a page, the tree of its paths and the elements that hold the blocks.

    A path is a node: ``parent``, ``depth``, a ``jump`` further up (for common prefixes in logarithmic
    time) and the element's name.  The path begins below the body.
    """

    texts: list[str] = field(default_factory=list)
    nodes: list[int] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    holders: list[int] = field(default_factory=list)  # element of each block
    parent: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    jump: list[int] = field(default_factory=lambda: [0])
    name: list[str] = field(default_factory=lambda: [""])
    up: list[int] = field(default_factory=lambda: [0])  # an element's parent, node and mark
    node_of: list[int] = field(default_factory=lambda: [0])
    mark: list[tuple[float, float] | None] = field(default_factory=lambda: [None])
    core: list[int] = field(default_factory=lambda: [0])  # 2: in an article, 1: in main
    _known: dict[tuple[int, str], int] = field(default_factory=dict)

    def node(self, parent: int, label: str, name: str) -> int:
        got = self._known.get((parent, label))
        if got is None:
            got = self._known[parent, label] = len(self.parent)
            j = self.jump[parent]
            even = self.depth[parent] - self.depth[j] == self.depth[j] - self.depth[self.jump[j]]
            self.parent.append(parent)
            self.depth.append(self.depth[parent] + 1)
            self.jump.append(self.jump[j] if even else parent)
            self.name.append(name)
        return got

    def common(self, a: int, b: int) -> int:
        """The deepest node above both."""
        if self.depth[a] < self.depth[b]:
            a, b = b, a
        while self.depth[a] > self.depth[b]:
            a = self.jump[a] if self.depth[self.jump[a]] >= self.depth[b] else self.parent[a]
        while a != b:
            a, b = (self.jump[a], self.jump[b]) if self.jump[a] != self.jump[b] else (self.parent[a], self.parent[b])
        return a

    def child(self, top: int, node: int) -> int:
        """The node below ``top`` on the way to ``node``."""
        while self.depth[node] > self.depth[top] + 1:
            node = self.jump[node] if self.depth[self.jump[node]] > self.depth[top] else self.parent[node]
        return node

    def related(self, a: int, b: int) -> float:
        """Share of two paths that is their common prefix; siblings that hold text count half at least."""
        if a == b:
            return 1.0
        k = self.depth[self.common(a, b)]
        sim = k / max(self.depth[a], self.depth[b], 1)
        if self.depth[a] == self.depth[b] == k + 1 and self.name[a] in LEAVES:
            sim = max(sim, 0.5)
        return sim


def read(page: str) -> Page:
    """One pass over the page."""
    out = Page()
    stack: list[tuple[str, int, bool]] = []  # element's name and number, and whether text in it is never shown
    where: dict[str, list[int]] = {}  # places in the stack by name
    buf: list[str] = []
    state = {"link": 0, "links": 0}

    def flush() -> None:
        if buf:
            text = " ".join("".join(buf).split())
            buf.clear()
            if text:
                number = stack[-1][1] if stack else 0
                out.texts.append(text)
                out.nodes.append(out.node_of[number])
                out.links.append(state["links"])
                out.holders.append(number)
        state["links"] = 0

    def last(names: set[str]) -> int:
        return max((where[n][-1] for n in names if where.get(n)), default=-1)

    def close(names: set[str], scope: set[str]) -> None:
        i = last(names)
        if i >= 0 and i >= last(scope):
            flush()
            while len(stack) > i:
                where[stack.pop()[0]].pop()

    def say(raw: str) -> None:
        if raw and not (stack and stack[-1][2]):
            text = html_.unescape(raw) if "&" in raw else raw
            buf.append(text)
            if state["link"]:
                state["links"] += len(text.strip())

    at, size = 0, len(page)
    while at < size:
        m = _OPEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[1]:
            end = page.find("-->", at - 2 if page.startswith(">", at) else at)
            at = size if end < 0 else end + 3
            continue
        if m[2] or m[5]:
            end = page.find(">", at)
            at = size if end < 0 else end + 1
            continue
        name = m[4].lower()
        at, found, alone = _attributes(page, at)
        if at < 0:
            break  # a tag that never ends
        if name == "br":
            say(" ")
        elif name == "a":
            state["link"] = 0 if m[3] else 1
        elif name in INLINE:
            pass
        elif m[3]:
            close({name}, NO_SCOPE if name in SCOPE else TOP - {name})
        else:
            if name not in VOID:
                if name not in RAW:
                    close({"p"}, P_SCOPE)
                if name in CLOSES:
                    close(CLOSES[name], SCOPE)
            flush()
            if name in VOID:
                continue
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = size if end is None else page.find(">", end.end()) + 1 or size
                continue
            label, weight, head = _marks(found) if found else ("", None, False)
            hidden = (bool(stack) and stack[-1][2]) or name in NEVER
            weight = None if name in ("html", "body", "article", "main") else _lower(weight, SOFT.get(name))
            if (name == "header" or head) and not (where.get("article") or where.get("main")):
                weight = _lower(weight, WHOLE)
            if not alone or name in ("p", "div"):
                above = stack[-1][1] if stack else 0
                node = 0 if name in ("html", "body") else out.node(out.node_of[above], name + label, name)
                out.up.append(above)
                out.node_of.append(node)
                out.mark.append(weight)
                out.core.append(max(out.core[above], 2 if name == "article" else name == "main"))
                where.setdefault(name, []).append(len(stack))
                stack.append((name, len(out.up) - 1, hidden))
                state["link"] = 0
    flush()
    return out


NO_SCOPE: set[str] = set()
TOP = {"article", "main", "body"}
P_SCOPE = {"article", "main", "body", "td", "th", "li", "div", "section", "button"}


def _ratio(chars: float, punct: float, blocks: float) -> float:
    return chars / blocks * (1 + punct / blocks) if blocks else 0.0


def said(page: Page) -> list[int]:
    """Characters of sentences in each block; where there are none, of text outside links, or of all text."""
    plain = [max(0, len(t) - n) for t, n in zip(page.texts, page.links, strict=True)]
    prose = [n if page.name[p] in PROSE or _END.search(t) else 0 for t, n, p in zip(page.texts, plain, page.nodes, strict=True)]
    return next((x for x in (prose, plain) if any(x)), list(map(len, page.texts)))


def unmarked(page: Page) -> tuple[list[int], int]:
    """Numbers of the blocks that marks leave, and what is the article: 2 the articles, 1 main, 0 anything."""
    size, words = len(page.up), said(page)
    core = max((page.core[h] for k, h in enumerate(page.holders) if words[k]), default=0)
    if not any(page.mark):
        return list(range(len(page.texts))), core
    sums = [[0, 0, 0, 0, 0] for _ in range(size)]  # text outside links, punctuation, blocks, sentences, the article's sentences
    for k, h in enumerate(page.holders):
        for i, x in enumerate((max(0, len(page.texts[k]) - page.links[k]), len(_PUNCT.findall(page.texts[k])), 1, words[k], words[k] * (core > 0 and page.core[h] >= core))):
            sums[h][i] += x
    own = [list(x) for x in sums]
    for e in range(size - 1, 0, -1):  # an element comes after the one that holds it
        above = sums[page.up[e]]
        for i, x in enumerate(sums[e]):
            above[i] += x
    inside = [core > 0 and c >= core for c in page.core]
    # Wrappers are no marks.
    mark = [None if m and not inside[e] and (sums[e][4] or not core and sums[e][3] >= WRAPPER * sums[0][3]) else m for e, m in enumerate(page.mark)]
    marked, paths = [False] * size, {}
    for e in range(size):
        marked[e] = bool(e) and (marked[page.up[e]] or mark[e] is not None)
        if not marked[e] and own[e][2] and (inside[e] or not core):
            t = paths.setdefault(page.node_of[e], [0, 0, 0])
            for i in range(3):
                t[i] += own[e][i]
    best = max(paths.values(), key=lambda t: t[0] * (1 + t[1] / t[2]), default=[0, 0, 0])
    base = _ratio(*best)
    gone = [False] * size
    for e in range(1, size):
        gone[e] = gone[page.up[e]]
        if mark[e] is not None and not gone[e]:
            gone[e] = core > 0 and not inside[e] or mark[e][not inside[e]] * _ratio(*sums[e][:3]) < SHARE * base
    kept = [k for k, h in enumerate(page.holders) if not gone[h]]
    return kept if any(words[k] for k in kept) else list(range(len(page.texts))), core


def records(page: Page, kept: list[int], core: int) -> set[int]:
    """Blocks of lists of like records with bylines that are not the article."""
    record = [0] * len(page.up)  # the innermost element at or above each one that may be a record
    for e in range(1, len(page.up)):
        record[e] = e if page.name[page.node_of[e]] in RECORD else record[page.up[e]]
    chains: dict[int, list[int]] = {}
    for k in kept:
        if e := record[page.holders[k]]:
            chains.setdefault(e, []).append(k)
    by: dict[tuple[int, int], list[list[int]]] = {}
    for e, got in chains.items():
        by.setdefault((page.up[e], page.node_of[e]), []).append(got)
    ends = {k: bool(_END.search(page.texts[k])) for k in kept}
    lists: list[tuple[int, list[int]]] = []
    for (above, _), groups in by.items():
        if len(groups) > 1 and all(len(g) > 1 and len(page.texts[g[0]]) <= BYLINE and not ends[g[0]] and page.name[page.nodes[g[0]]] not in HEADINGS and any(ends[k] for k in g[1:]) for g in groups):
            lists.append((above, sorted(k for g in groups for k in g)))
    among = {k for _, ks in lists for k in ks}
    rest = [k for k in kept if ends[k] and k not in among]
    homes = {page.up[page.holders[k]] for k in rest}
    in_core = lambda k: not core or page.core[page.holders[k]] >= core
    whole = sum(len(page.texts[k]) for k in kept if ends[k] and in_core(k))
    mean = lambda ks: _ratio(sum(len(page.texts[k]) for k in ks), sum(len(_PUNCT.findall(page.texts[k])) for k in ks), len(ks))
    usual = mean([k for k in rest if in_core(k)])
    out: set[int] = set()
    for above, ks in lists:
        told = [k for k in ks if ends[k]]
        if not in_core(ks[0]):
            out.update(ks)
        elif above in homes:  # among the article's own paragraphs
            if mean(told) < MOST * usual:
                out.update(ks)
        elif sum(len(page.texts[k]) for k in told) <= MOST * whole and not any(k > ks[-1] for k in rest if in_core(k)):
            out.update(ks)
    return out


def content(page: Page) -> list[str]:
    """Texts of the blocks whose path passes the threshold."""
    kept, core = unmarked(page)
    apart = records(page, kept, core)
    return [page.texts[k] for k in _passing(page, [k for k in kept if k not in apart])]


def _passing(page: Page, kept: list[int]) -> list[int]:
    if not kept:
        return []
    linked = all(page.links[k] >= len(page.texts[k]) for k in kept)
    total: dict[int, list[float]] = {}
    for k in kept:
        t = total.setdefault(page.nodes[k], [0, 0, 0, 0])
        text = page.texts[k]
        t[0] += len(text) if linked else max(0, len(text) - page.links[k])
        t[1] += len(_PUNCT.findall(text))
        t[2] += 1
        t[3] += len(text)
    ratio = {p: t[0] / t[2] * (1 + t[1] / t[2]) for p, t in total.items()}
    weights = [math.exp(-(d * d) / 2) for d in range(-RADIUS, RADIUS + 1)]
    paths = [page.nodes[k] for k in kept]
    smooth: dict[int, list[float]] = {}
    for i, path in enumerate(paths):
        near = [(w, ratio[paths[j]]) for j, w in zip(range(i - RADIUS, i + RADIUS + 1), weights, strict=True) if 0 <= j < len(paths) and page.related(path, paths[j]) > 0]
        smooth.setdefault(path, []).append(sum(w * r for w, r in near) / sum(w for w, _ in near) if near else ratio[path])
    score = {p: sum(v) / len(v) for p, v in smooth.items()}
    if max(score.values()) <= 0:
        return []
    best = max(total, key=lambda p: (total[p][0] * (1 + total[p][1] / total[p][2]), -p))
    keep = set()
    for p in score:
        kin = page.related(p, best)
        fused = max(score[p] * (0.3 + 0.7 * kin), score[best] * kin)
        only_links = total[p][0] < 0.2 * total[p][3] and total[p][1] < total[p][2]
        if fused >= SHARE * score[best] and not only_links:
            keep.add(p)
    return [k for k, p in zip(kept, paths, strict=True) if p in keep]


def main_text(page: str | None) -> str:
    return "\n".join(content(read(page or "")))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512, "html"):
            got = [main_text(p) for p in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())], ["page_id", "url", "text", "n_chars"])

    src = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
