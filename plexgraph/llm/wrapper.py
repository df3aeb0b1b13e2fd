"""Main-text extraction by wrapper induction.

Pages of one host are aligned: the block structure of each page is merged into its host's template by
simple tree matching (the largest order-preserving matching of equal labels, level by level), and
every template node counts the pages that have it.  Then each page is aligned with its host's template,
and the pages of each text at each node are counted.  Nodes whose text most pages
share are template; nodes whose text varies are slots.  The template's region of content is its node
that holds most of the varying text, with the article around it, or else with the nearest varying main
heading; a page's content are the blocks in slots of that region.

What a template cannot tell is read from the markup: elements that by their name, role or class are
menus, headers, footers, sidebars, notices, adverts, forms or reader comments are aligned like all
others, but are never content, even where their text varies.  Whole tokens of a class or id tell, and
of a block's compound tokens (comments-area, site-footer) the first and the last part, unless the
block holds more than half of the page's text.  What holds the page's main (or, without one, all its
articles) is never left out.  Where no part of the template holds most of the varying text, the region
is the part with the longest runs of text, if they are twice as long as those beside it and weigh more
than all of them; its headings are then those inside it.  Where most of
the region is constant, the pages are copies of each other and all of it is content.  On a host of
fewer than MIN_PAGES pages, where nothing can be told from the others, and on a page that lacks its
template's region, the articles (or mains) of the page itself are the region.

Templates are merged in three steps: a task holds those of FEW_HOSTS hosts or of TOGETHER pages at
once, the others one host's.  The pages of (host, node, text) are counted exactly, by a grouping that is partial
in each task first; a template keeps the texts that most pages share.  Repeated parts of a page (runs
of up to four labels) are one node, so a tree is as wide as its page is varied, and all walks over
trees use stacks of their own, so depth is no limit.  Pages are parsed in every one of the three
passes: storing parsed trees would take more disk than the pages.

Edge cases: a null or empty html gives an empty text; a null URL belongs to the host ''; a host with
fewer than MIN_PAGES pages has no constant nodes; unclosed and stray tags are closed or ignored as
browsers do; of alignments of equal weight the one that skips the template's nodes first is taken; a
very long or deep page is held by one task; repeated rows are extracted alike; an empty table gives no
rows; an input column named like the result column (text) is replaced, all others are kept.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import columns, drop_staged, ready, stage, table
from .url_filter import split_url

MIN_PAGES, CONSTANT, COPIES = 5, 0.5, 0.5
PARTS = 64
#: A task hands on the templates of more than FEW_HOSTS hosts after so many pages, so it holds no more of them at once.
TOGETHER, FEW_HOSTS = 1024, 32
#: Templates of all hosts that are broadcast at most; beyond, they are joined by host and salt.
BROADCAST_CHARS, SALTS = 32 << 20, 64

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*\Z""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
NAME_PARTS = re.compile(r"[a-z]+")
COMPOUND = re.compile(r"[-_]+")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
ENDS_P = BLOCK - {"body", "caption", "dd", "dt", "head", "html", "legend", "li", "tbody", "tfoot", "thead", "tr"} | {"hr", "li", "dd", "dt"}
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = {"td", "th", "caption", "html", "button", "object", "template"}
#: Names of elements, roles and classes that mark what is not an article.
NEVER = {"aside", "button", "dialog", "footer", "form", "menu", "nav", "search"}
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disclaimer", "disqus", "footer", "gdpr", "header", "login",
    "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "share", "sharing", "sidebar", "sidenav",
    "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget",
}
#: Of a compound token that begins with one of the first, nothing is told; those of the second name an article's own header.
RELATIVE = {"has", "is", "no", "not", "with", "without"}
OWN = {"article", "content", "entry", "page", "post", "section", "story"}
#: Of these, browsers show nothing that is read as text; of the first, not even an article inside.
INERT = {"template", "noscript"}
UNSEEN = {"audio", "canvas", "datalist", "embed", "head", "iframe", "input", "map", "noscript", "object", "select", "svg", "template", "video"} | RAW
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that tell something without an attribute, and those that go from an article's own header.
TOLD = INERT | UNSEEN | NEVER | {"header"}
HEADED = BLOCK - HEADINGS - {"div", "header", "hgroup", "section"}
NOTHING: dict[str, str] = {}
#: Labels that a repeated part of a page has at most.
PERIOD = 4


class Block:
    """A block element, or a run of text between blocks (label "#"); aside tells what by its markup is no content."""

    __slots__ = ("aside", "kids", "label", "links", "tag", "text")

    def __init__(self, tag: str, label: str, aside: bool = False):
        self.tag, self.label, self.kids, self.text, self.links, self.aside = tag, label, [], "", 0, aside


def _never(tag: str, said: dict[str, str], inside_article: bool) -> int:
    """2: not shown as text; 1: shown, but no content by its markup; 0: neither."""
    if said and tag not in ("html", "body") and (("style" in said and _hidden(said["style"])) or said.get("aria-hidden") == "true"):
        return 2
    if tag in NEVER or (tag == "header" and not inside_article):
        return 1
    if not said or tag in ("html", "body"):
        return 0
    if said.get("role", "").lower() in ROLES:
        return 1
    if tag in ("article", "main"):
        return 0
    return 0 if MARKS.isdisjoint(f"{said.get('class', '')} {said.get('id', '')}".lower().split()) else 1


def _partly(tag: str, said: dict[str, str], inside_article: bool) -> bool:
    """Whether a part of a compound token marks a block; ids (often a heading's words) only of a div outside articles."""
    if tag in ("html", "body", "article", "main") or tag in HEADINGS:
        return False
    told = said.get("class", "") + (" " + said.get("id", "") if tag == "div" and not inside_article else "")
    for token in told.lower().split():
        parts = [x for x in COMPOUND.split(token) if x]
        if len(parts) < 2 or parts[0] in RELATIVE or (parts[-1] in ("header", "banner") and (inside_article or parts[0] in OWN)):
            continue
        if parts[0] in MARKS or parts[-1] in MARKS:
            return True
    return False


def _hidden(style: str) -> bool:
    """Whether declarations end up as display: none or visibility: hidden."""
    told: dict[str, tuple[bool, str]] = {}
    for x in COMMENT.sub(" ", entities.unescape(style)).lower().split(";"):
        name, colon, value = x.partition(":")
        value, bang, _ = value.partition("!")
        name, strong = name.strip(), bool(bang)
        if colon and (strong or not told.get(name, (False, ""))[0]):
            told[name] = strong, value.strip()
    return told.get("display", (False, ""))[1] == "none" or told.get("visibility", (False, ""))[1] == "hidden"


def parse(source: str | None) -> Block:
    """The page's tree of blocks, without what is never shown as text."""
    root, found, partly = _parse(source or "", frozenset())
    kept = _held(root, partly)
    if kept:
        root, found, _ = _parse(source or "", kept)
    chosen = [x for x in found if x[0] == "main"] or found
    if chosen and all(mute for _, _, mute in chosen):
        holders = [holder for _, holder, _ in chosen]
        spared = frozenset.union(*holders) if chosen[0][0] == "main" else frozenset.intersection(*holders)
        if spared:
            root, *_ = _parse(source or "", spared | kept)
    return root


def _held(root: Block, partly: list[tuple[int, Block]]) -> frozenset[int]:
    """The starts of those blocks that hold more than half of the page's text."""
    if not partly:
        return frozenset()
    order, rest = [], [root]
    while rest:
        order.append(rest.pop())
        rest += order[-1].kids
    chars: dict[int, int] = {}
    for b in reversed(order):
        chars[id(b)] = len(b.text) + sum(chars[id(k)] for k in b.kids)
    return frozenset(low for low, b in partly if 2 * chars[id(b)] > chars[id(root)])


def _parse(source: str, spared: frozenset[int]) -> tuple[Block, list[tuple[str, frozenset[int], int]], list[tuple[int, Block]]]:
    """The tree, the articles and mains (name, where the elements that hold it start, whether one of those is left out), and the blocks that a part of a token marks, with their starts.

    Elements that start where spared says are not left out."""
    root = Block("html", "html")
    found: list[tuple[str, frozenset[int], int]] = []
    partly: list[tuple[int, Block]] = []
    # Open elements: (tag, block that takes their text, mute, inside an article, start).
    open_: list[tuple[str, Block, int, bool, int]] = [("", root, 0, False, -1)]
    held: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal links
        if held:
            text = " ".join((held[0] if len(held) == 1 else "".join(held)).split())
            held.clear()
            if text:
                run = Block("#", "#")
                run.text, run.links, run.aside = text, min(links, len(text)), open_[-1][1].aside
                open_[-1][1].kids.append(run)
        links = 0

    def close(n: int) -> None:
        for tag, _, mute, *_ in open_[n:]:
            if tag in BLOCK and mute < 2:
                flush()
                break
        del open_[n:]

    at, end = 0, len(source)
    link = 0
    while at < end:
        low = source.find("<", at)
        while low >= 0 and not (m := TOKEN.match(source, low)):
            low = source.find("<", low + 1)
        if low < 0:
            m, low = None, end
        if low > at and open_[-1][2] < 2:
            some = source[at:low]
            if "&" in some:
                some = entities.unescape(some)
            held.append(some)
            if link:
                links += len(some)
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            if tag == "a":
                link = max(0, link - 1)
            for i in range(len(open_) - 1, 0, -1):
                if open_[i][0] == tag:
                    close(i)
                    break
                if open_[i][0] in BLOCK and tag not in BLOCK:
                    break  # a stray inline end tag does not end a block
            continue
        if tag in VOID:
            if tag == "br" or tag == "hr":
                if tag == "hr":
                    flush()
                held.append(" ") if open_[-1][2] < 2 else None
            continue
        if tag in ENDS_P:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i][0] == "p":
                    close(i)
                    break
                if open_[i][0] in SCOPE:
                    break
        if tag in SIBLINGS:
            same, stop = SIBLINGS[tag]
            for i in range(len(open_) - 1, 0, -1):
                if open_[i][0] in same:
                    close(i)
                    break
                if open_[i][0] in stop:
                    break
        _, into, mute, article, _ = open_[-1]
        if tag in ("article", "main"):
            found.append((tag, frozenset(x[4] for x in open_[1:]), mute))
        body = m[3] or ""
        said = {a.lower(): x or y or z for a, x, y, z in ATTRIBUTE.findall(body)} if "=" in body else NOTHING
        # 2: not shown as text; 1: shown, but no content. What is left out inside a line is not aligned.
        if said or tag in TOLD:
            mute = max(mute, 2 if tag in INERT else 0 if low in spared else 2 if tag in UNSEEN else _never(tag, said, article))
        marked = bool(said) and tag in BLOCK and mute < 2 and low not in spared and _partly(tag, said, article)
        if marked:
            mute = 1
        if mute == 1 and tag not in BLOCK and not open_[-1][2]:
            mute = 2
        if article and not mute and tag in HEADED and any(x[0] == "header" for x in open_):
            mute = 1  # of an article's own header, its headings stay
        if tag in RAW:
            stop = RAW_END[tag].search(source, at)
            at = stop.end() if stop else end
            continue
        if tag == "a":
            link += 1
        if tag in ("td", "th") and mute < 2:
            held.append(" ")
        if tag in BLOCK:
            if open_[-1][2] < 2:
                flush()
            if mute < 2:
                kinds = "".join(sorted("." + x for x in set(NAME_PARTS.findall(said["class"].lower())))) if "class" in said else ""
                own = Block(tag, ("!" if mute else "") + tag + kinds, mute > 0)
                into.kids.append(own)
                into = own
                if marked:
                    partly.append((low, own))
        if body.endswith("/") and tag not in BLOCK:
            continue
        open_.append((tag, into, mute, article or tag in ("article", "main") or said.get("role") == "main", low))
    flush()
    return root, found, partly


# A template node: [label, pages, chars, link chars, {text that most pages share: pages}, kids, runs of text].
def _node(label: str) -> list:
    return [label, 0, 0, 0, {}, [], 0]


def _mark(text: str) -> int:
    """A text by its length and hash."""
    return min(len(text), 0x7FFFFFFF) << 32 | crc32(text.encode("utf-8", "replace"))


def _numbered(node: list) -> list[list]:
    """A template's nodes, each before its kids."""
    out, rest = [], [node]
    while rest:
        out.append(rest.pop())
        rest += reversed(out[-1][5])
    return out


def repeats(labels: list[str]) -> list[list[int]]:
    """The places of equal parts of a row of labels: neighbours of one label, or of up to PERIOD labels, share their slots."""
    if len(set(labels)) == len(labels):
        return [[i] for i in range(len(labels))]
    names: list[str] = []
    slots: list[list[int]] = []
    for i, label in enumerate(labels):
        if names and names[-1] == label:
            slots[-1].append(i)
            continue
        names.append(label)
        slots.append([i])
        n = 2
        while n <= PERIOD and 2 * n <= len(names):
            if names[-1 - n] == names[-1] and names[-n:] == names[-2 * n : -n]:
                for into, own in zip(slots[-2 * n : -n], slots[-n:], strict=True):
                    into += own
                del names[-n:], slots[-n:]
                n = 1
            n += 1
    return slots


def of_page(block: Block) -> list:
    """A page's tree as a template of one page; repeated parts are one node."""
    order, rest = [], [(block, None)]
    while rest:
        own, holder = rest.pop()
        node = _node(own.label)
        node[1], node[2], node[3], node[6] = 1, len(own.text), own.links, int(bool(own.text))
        order.append(node)
        if holder:
            holder[5].append(node)
        rest += [(kid, node) for kid in reversed(own.kids)]
    for node in reversed(order):
        if len(node[5]) > 1 and len({k[0] for k in node[5]}) < len(node[5]):
            _work([("fold", node, None)], 0)
    return order[0]


def merge(into: list, other: list) -> list:
    """Merge a tree into a template of the same label."""
    _work([("merge", into, other)], None)
    return into


def _work(work: list[tuple], pages: int | None) -> None:
    """Merge and fold what is on the stack; parts of one page (pages 0) are folded again after their kids' merges."""
    known: dict[tuple[int, int], int] = {}
    while work:
        what, a, b = work.pop()
        if what == "fold":
            slots = repeats([k[0] for k in a[5]])
            if len(slots) < len(a[5]):
                kids, a[5] = a[5], [a[5][x[0]] for x in slots]
                work += [("merge", kids[x[0]], kids[y]) for x in slots for y in reversed(x[1:])]
            continue
        a[1] += b[1] if pages is None else pages
        a[2] += b[2]
        a[3] += b[3]
        a[6] += b[6]
        if not b[5]:
            continue
        if pages == 0:
            work.append(("fold", a, None))
        kids, i, j = [], 0, 0
        for x, y in [*align(a[5], b[5], known), (len(a[5]), len(b[5]))]:
            kids += a[5][i:x] + b[5][j:y]
            if x < len(a[5]):
                kids.append(a[5][x])
                work.append(("merge", a[5][x], b[5][y]))
            i, j = x + 1, y + 1
        a[5] = kids


def _same(a: list[list], b: list[list]) -> bool:
    return len(a) == len(b) and all(x[0] == y[0] for x, y in zip(a, b, strict=True))


def match(a: list, b: list, known: dict[tuple[int, int], int] | None = None) -> int:
    """Simple tree matching: nodes in the largest order-preserving matching of two trees."""
    known = {} if known is None else known
    work = [(a, b)]
    while work:
        x, y = work[-1]
        if (id(x), id(y)) in known:
            work.pop()
            continue
        if x[0] != y[0]:
            known[id(x), id(y)] = 0
            work.pop()
            continue
        pairs = zip(x[5], y[5], strict=True) if _same(x[5], y[5]) else ((p, q) for p in x[5] for q in y[5] if p[0] == q[0])
        lack = [(p, q) for p, q in pairs if (id(p), id(q)) not in known]
        plain = [(p, q) for p, q in lack if not p[5] or not q[5]]
        known.update(((id(p), id(q)), 1) for p, q in plain)
        if len(plain) < len(lack):
            work += [(p, q) for p, q in lack if p[5] and q[5]]
            continue
        known[id(x), id(y)] = 1 + sum(known[id(x[5][i]), id(y[5][j])] for i, j in align(x[5], y[5], known))
        work.pop()
    return known[id(a), id(b)]


def align(a: list[list], b: list[list], known: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """Pairs of the heaviest order-preserving matching of two lists of nodes, equal ends apart."""
    if _same(a, b):
        return [(i, i) for i in range(len(a))]
    low = 0
    while low < min(len(a), len(b)) and a[low][0] == b[low][0]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high][0] == b[-1 - high][0]:
        high += 1
    out = [(i, i) for i in range(low)]
    x, y = a[low : len(a) - high], b[low : len(b) - high]
    if x and y:
        places: dict[str, list[int]] = {}
        for j, q in enumerate(y):
            places.setdefault(q[0], []).append(j)
        best = [[0] * (len(y) + 1)]
        weights: list[dict[int, int]] = []
        for p in reversed(x):
            own = {j: match(p, y[j], known) if p[5] and y[j][5] else 1 for j in places.get(p[0], ())}
            weights.append(own)
            under = best[-1]
            if not own:
                best.append(under)
                continue
            row = under[:]
            for j in range(len(y) - 1, -1, -1):
                top = row[j + 1] if row[j + 1] > under[j] else under[j]
                if j in own and under[j + 1] + own[j] > top:
                    top = under[j + 1] + own[j]
                row[j] = top
            best.append(row)
        best.reverse()
        weights.reverse()
        i = j = 0
        while i < len(x) and j < len(y):
            if j in weights[i] and best[i][j] == best[i + 1][j + 1] + weights[i][j]:
                out.append((low + i, low + j))
                i, j = i + 1, j + 1
            elif best[i][j] == best[i + 1][j]:
                i += 1
            else:
                j += 1
    return out + [(len(a) - n, len(b) - n) for n in range(high, 0, -1)]


def region(template: list) -> list | None:
    """The template's node that holds most of the varying text, or else the longest runs of it; None where none varies."""
    total = template[1]
    order = _numbered(template)
    runs: dict[int, int] = {}  # runs of such text
    varies: dict[int, int] = {}  # chars of a node and below that are neither links nor aside nor of texts that most pages share
    heading: set[int] = set()  # nodes that have a varying main heading
    for node in reversed(order):
        shared = sum((int(mark) >> 32) * n for mark, n in node[4].items() if n >= CONSTANT * total) if total >= MIN_PAGES else 0
        own = 0 if node[0][0] == "!" else max(0, node[2] - node[3] - shared) + sum(varies[id(k)] for k in node[5])
        varies[id(node)] = own
        runs[id(node)] = (node[6] if own and node[0] == "#" else 0) + sum(runs[id(k)] for k in node[5] if varies[id(k)])
        if own and (node[0].split(".")[0] == "h1" or any(id(k) in heading for k in node[5])):
            heading.add(id(node))
    whole, path = varies[id(template)], [template]
    if not whole:
        return None
    low = 0  # where the path last went by the length of runs
    while True:
        kid = max((k for k in path[-1][5] if k[0] != "#"), key=lambda k: varies[id(k)], default=None)
        if kid is not None and 2 * varies[id(kid)] <= whole:
            kid = _longest([k for k in path[-1][5] if varies[id(k)]], varies, runs)
            if kid is not None:
                whole, low = varies[id(kid)], len(path)
        if kid is None or kid[1] < CONSTANT * path[-1][1] or kid[0].split(".")[0] in ("p", "li", "tr", "td", "pre", "blockquote", *HEADINGS):
            break
        path.append(kid)
    path = path[min(low, len(path) - 1) :]
    held = next((x for x in path if x[0].split(".")[0] == "article"), None)
    return held or next((x for x in reversed(path) if id(x) in heading), path[-1])


def _longest(kids: list[list], varies: dict[int, int], runs: dict[int, int]) -> list | None:
    """The kid whose runs of varying text are twice as long as those of its siblings together, and weigh more, by chars x mean length."""
    weight = {id(k): varies[id(k)] ** 2 / max(1, runs[id(k)]) for k in kids}
    best = max((k for k in kids if k[0] != "#"), key=lambda k: weight[id(k)], default=None)
    if best is None or 2 * weight[id(best)] <= sum(weight.values()):
        return None
    rest = [k for k in kids if k is not best]
    chars, n = sum(varies[id(k)] for k in rest), sum(runs[id(k)] for k in rest)
    return best if varies[id(best)] * max(1, n) >= 2 * chars * max(1, runs[id(best)]) else None


def _articles(block: Block) -> list[Block]:
    for tag in ("article", "main"):
        out, rest = [], [block]
        while rest:
            b = rest.pop()
            if b.tag == tag and not b.aside:
                out.append(b)
            else:
                rest += reversed(b.kids)
        if out:
            return out
    return []


def _runs(block: Block, node: list | None) -> Iterator[tuple[Block, list | None]]:
    """Every block below block and itself, in page order, with the template node that it aligns with."""
    rest: list[tuple[Block, list | None]] = [(block, node)]
    while rest:
        block, node = rest.pop()
        yield block, node
        if not block.kids:
            continue
        if not node or not node[5]:
            rest += [(k, None) for k in reversed(block.kids)]
            continue
        have, labels = node[5], [k.label for k in block.kids]
        mates: list[list | None] = [None] * len(labels)
        slots = repeats(labels)
        if len(slots) == len(have) and all(labels[x[0]] == k[0] for x, k in zip(slots, have, strict=True)):
            pairs = enumerate(range(len(slots)))
        else:
            pairs = align([[k[0], 0, 0, 0, {}, []] for k in have], [[labels[x[0]], 0, 0, 0, {}, []] for x in slots], {})
        for i, j in pairs:
            for x in slots[j]:
                mates[x] = have[i]
        rest += zip(reversed(block.kids), reversed(mates), strict=True)


def extract(root: Block, template: list | None, wanted: list | None = None) -> str:
    """The page's main text, by its host's template; wanted is the template's region, if it is known already."""
    total = template[1] if template else 0
    met = list(_runs(root, template))
    inside: set[int] = set()
    if total >= MIN_PAGES and (wanted := wanted or region(template)) is not None:
        inside = {id(b) for b, n in met if n is wanted}
    inside = inside or {id(b) for b in _articles(root)} or {id(root)}
    runs: list[tuple[Block, list | None]] = []
    for block, node in met:
        if id(block) in inside:
            inside.update(id(k) for k in block.kids)
            if block.text and not block.aside:
                runs.append((block, node))
    fixed = [bool(n) and total >= MIN_PAGES and n[4].get(str(_mark(b.text)), 0) >= CONSTANT * total for b, n in runs]
    if sum(len(b.text) for (b, _), f in zip(runs, fixed, strict=True) if f) > COPIES * sum(len(b.text) for b, _ in runs):
        fixed = [False] * len(runs)
    return "\n\n".join(b.text for (b, _), f in zip(runs, fixed, strict=True) if not f)


def _pack(node: list) -> str:
    """The nodes in order, each with the number of its kids in their place."""
    return json.dumps([[*n[:5], len(n[5]), n[6]] for n in _numbered(node)], separators=(",", ":"))


def _unpack(packed: str) -> list:
    nodes = json.loads(packed)
    lack: list[list] = []  # nodes that wait for kids, with how many
    for node in nodes:
        if lack:
            holder = lack[-1]
            holder[0][5].append(node)
            holder[1] -= 1
            if not holder[1]:
                lack.pop()
        if node[5]:
            lack.append([node, node[5]])
        node[5] = []
    return nodes[0]


def templates(pages: DataFrame) -> DataFrame:
    """host, pages and template (JSON, without texts): one row for each host of pages (columns host, html)."""
    ready(pages.sparkSession)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found: dict[str, list] = {}
        part, merged = TaskContext.get().partitionId() % PARTS, 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([part] * len(found), pa.int32()), pa.array([_pack(t) for t in found.values()], pa.string())], ["host", "part", "template"])

        for batch in batches:
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = of_page(parse(source.as_py()))
                if host in found:
                    merge(found[host], page)
                else:
                    found[host] = page
                merged += 1
                if merged >= TOGETHER and len(found) > FEW_HOSTS:
                    yield told()
                    found.clear()
                    merged = 0
        yield told()

    def join(group: pa.Table) -> pa.Table:
        out = None
        for x in group.column("template"):
            node = _unpack(x.as_py())
            out = merge(out, node) if out else node
        return pa.table({"host": group.column("host").slice(0, 1), "pages": pa.array([out[1]], pa.int64()), "template": pa.array([_pack(out)], pa.string())})

    some = pages.select("host", "html").mapInArrow(own, "host string, part int, template string")
    some = some.groupBy("host", "part").applyInArrow(join, "host string, pages long, template string")
    return some.groupBy("host").applyInArrow(join, "host string, pages long, template string")


def _met(pages: DataFrame, known: DataFrame) -> tuple[DataFrame, Broadcast | None]:
    """pages (columns __url, __html, __key: host) with __id, __pages and __template of their host in known (staged), and what they lack.

    Templates of a checked size are sent to each worker once, as {host: (id, pages, template)}, and the
    columns are null; beyond it they travel with the pages."""
    names = ["__id", "__pages", "__template"]
    if (known.agg(F.sum(F.length("__template"))).first()[0] or 0) <= BROADCAST_CHARS:
        shared = pages.sparkSession.sparkContext.broadcast({r[0]: tuple(r)[1:] for r in known.select("__host", *names).collect()})
        return pages.select("*", F.lit(None).cast("long").alias(names[0]), F.lit(None).cast("long").alias(names[1]), F.lit(None).cast("string").alias(names[2])), shared
    # A host of any size is spread over SALTS tasks or more.
    salted = known.withColumn("__nth", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pages = pages.withColumn("__salt", F.pmod(F.xxhash64("__url", F.crc32("__html")), F.lit(SALTS)).cast("int"))
    return pages.join(salted.hint("shuffle_hash"), (F.col("__key") == F.col("__host")) & (F.col("__salt") == F.col("__nth")), "left"), None


def _of_host(shared: Broadcast | None, host: str | None, own: tuple[int | None, int | None, pa.Scalar]) -> tuple[int | None, int | None, str | None]:
    """(id, pages, template) of a page's host, from the row itself or from what the worker has."""
    return (own[0], own[1], own[2].as_py()) if shared is None else shared.value.get(host, (None, None, None))


def with_texts(pages: DataFrame, known: DataFrame) -> DataFrame:
    """known (columns __id, __host, __pages, __template), its nodes with the texts that most of the host's pages have there."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, tuple[list, dict[int, int]]] = {}
        for batch in batches:
            n: Counter[tuple[int, int, int, int]] = Counter()
            for host, source, *own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                key, total, packed = _of_host(shared, host, own)
                if key is None:
                    continue
                if key not in have:
                    have.clear() if len(have) > 64 else None
                    template = _unpack(packed)
                    have[key] = template, {id(node): i for i, node in enumerate(_numbered(template))}
                template, nth = have[key]
                n.update({(key, total, nth[id(node)], _mark(b.text)) for b, node in _runs(parse(source.as_py()), template) if node and b.text})
            keys = list(n)
            columns = [pa.array([k[i] for k in keys], pa.int32() if i == 2 else pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(n.values()), pa.int64())], ["__id", "__pages", "node", "mark", "n"])

    def fill(packed: pa.Array, shared: pa.Array) -> pa.Array:
        out = []
        for source, texts in zip(packed, shared, strict=True):
            if texts.as_py():
                template = _unpack(source.as_py())
                nodes = _numbered(template)
                for x in texts.as_py():
                    nodes[x["node"]][4][str(x["mark"])] = x["n"]
                out.append(_pack(template))
            else:
                out.append(source.as_py())
        return pa.array(out, pa.string())

    seen, shared = _met(pages, known.where(F.col("__pages") >= MIN_PAGES))
    counts = seen.select("__key", "__html", "__id", "__pages", "__template").mapInArrow(own, "__id long, __pages long, node int, mark long, n long")
    counts = counts.groupBy("__id", "__pages", "node", "mark").agg(F.sum("n").alias("n")).where(F.col("n") >= CONSTANT * F.col("__pages"))
    texts = counts.groupBy(F.col("__id").alias("__of")).agg(F.sort_array(F.collect_list(F.struct("node", "mark", "n"))).alias("__texts"))
    met = known.join(texts, F.col("__id") == F.col("__of"), "left")
    return met.select("__id", "__host", "__pages", F.arrow_udf(fill, "string")("__template", "__texts").alias("__template"))


def main_text(pages: DataFrame) -> DataFrame:
    """pages (columns url, html) with text."""
    host, html = split_url(F.col("url"))[0], F.col("html").cast("string")
    known = templates(pages.select(host.alias("host"), html.alias("html"))).select(F.monotonically_increasing_id().alias("__id"), F.col("host").alias("__host"), F.col("pages").alias("__pages"), F.col("template").alias("__template"))
    keyed = pages.select(F.struct(*columns(pages, "text")).alias("__row"), F.col("url").alias("__url"), html.alias("__html"), host.alias("__key"))
    bare = stage(known, "templates")
    known = stage(with_texts(keyed.select("__url", "__html", "__key"), bare), "templates")
    drop_staged(bare)
    met, shared = _met(keyed, known)

    def own(sources: pa.Array, hosts: pa.Array, templates: pa.Array) -> pa.Array:
        seen: dict[str | None, tuple[list | None, list | None]] = {}
        out = []
        for source, host, packed in zip(sources, hosts.to_pylist(), templates, strict=True):
            if host not in seen:
                seen.clear() if len(seen) > 64 else None
                packed = _of_host(shared, host, (None, None, packed))[2]
                template = _unpack(packed) if packed else None
                seen[host] = template, region(template) if template and template[1] >= MIN_PAGES else None
            out.append(extract(parse(source.as_py()), *seen[host]))
        return pa.array(out, pa.string())

    met = met.select("__row", F.arrow_udf(own, "string")("__html", "__key", "__template").alias("__text"))
    return met.select("__row.*", F.col("__text").alias("text"))


def op4_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
