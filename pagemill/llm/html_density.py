"""Main-text extraction by composite text density.

Every DOM node gets a density: characters per tag, damped by the share of link characters and link tags. A node's
density sum adds the densities of its children. The node with the largest sum is the core of the page; the smallest
density on the path from it up to ``body`` is the threshold. A subtree beside that path is content if its density
reaches the threshold; beside the path but within the core's own ``article`` or ``main`` any density above zero does,
as captions and short remarks belong to their article. Text that stands in a node of the path itself counts as a
subtree of one tag.

Menus, headers (an article's own too), footers, asides, form controls and hidden parts are cut by their element, role
or state. Words of class and id only hint: the text of a hinted element (adverts, notices, reader comments, sidebars)
counts as link text, which takes its density to zero. A hint is void on what wraps the page's largest article, and on
an element without which less than a quarter of the page's text would be left and no article. The head of a name
decides: ``has-sidebar`` and ``ad-free`` hint at nothing. Forms go unless they hold half of the text.

Defined results: null or empty html gives an empty text; markup without text gives an empty text; text without any tag
is one block; rows may repeat; extra input columns are ignored. Time and memory for a page are linear in its length.
"""

from __future__ import annotations

import html as entities
import math
import re

from pyspark.sql import DataFrame

from pagemill.llm.common import arrow_map

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table"
    " tbody tfoot thead tr caption ul".split()
)
CELL = frozenset(["td", "th"])
CLOSES_P = BLOCK - {"body", "html", "dd", "dt", "li", "option", "optgroup", "tr", "tbody", "thead", "tfoot", "caption"}
P_SCOPE = frozenset("table td th caption button object html body".split())
SIBLING_CLOSE = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
FURNITURE = frozenset("nav header footer aside button select input dialog menu object embed applet canvas audio video".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion banner"
    " sidebar nav navbar navigation menu breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr"
    " notice notification alert popup modal overlay comment comments commentlist disqus discussion respond reply replies"
    " related recommended recommendations share sharing social newsletter subscribe subscription signup login search"
    " pagination pager toolbar skip widget".split()
)
#: Words before a name's head that turn it into its opposite or a mere trait, and tails that say only what shape it has.
TRAITS = frozenset("has have no not non with without hide show is can".split())
SHAPES = frozenset(
    "area bar bars block body bottom box btn button buttons col column container form group holder icon icons inner item items left link links list"
    " message outer panel right row section slot text title top unit wrap wrapper zone".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
KEEP = frozenset(["html", "body", "article", "main"])
#: Their id is an anchor made from their own words.
TITLED = frozenset("h1 h2 h3 h4 h5 h6 p".split())

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[(?:.*?\]\]>|.*\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)(?:((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)|([^>]*+))>",
    re.S,
)
#: Once a quote stays open to the page's end, quotes no longer hide a ">".
LOOSE = re.compile(TOKEN.pattern.replace("((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)|", "(?!)()|"), re.S)
COMMENT = re.compile(r"<!--.*|<[!?].*", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HINT_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _hints(name: str) -> bool:
    """Whether a class or id names page furniture: its head, the last word that is no mere shape, is a hint."""
    words = [w.lower() for w in HINT_WORD.findall(name)]
    while len(words) > 1 and words[-1] in SHAPES:
        words.pop()
    return bool(words) and words[-1] in HINTS and TRAITS.isdisjoint(words[:-1])


def _cut_off(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is page furniture by its name, role or state, and whether its class or id hints at it."""
    if tag in FURNITURE:
        return True, False
    if not attributes or tag in KEEP:
        return False, False
    hinted = False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "class":
            hinted = hinted or any(map(_hints, value.split()))
        elif name == "id" and tag not in TITLED:
            # A section of an article has the words of its heading as its id.
            words = [w.lower() in HINTS for w in HINT_WORD.findall(value)]
            hinted = hinted or (all(words) and bool(words) if tag == "section" and inside else _hints(value))
        elif name == "role" and value.strip().lower() in ROLES:
            return True, False
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return True, False
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False
    return False, hinted


class _Page:
    """Flat DOM: parallel lists by node, and text segments (block number, node, text) in page order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.cut, self.hinted = ["html"], [-1], [False], [False]
        self.segments: list[tuple[int, int, str]] = []
        self._stack, self._block = [0], 0
        self._open: dict[str, list[int]] = {"html": [0]}  # places in the stack, by tag
        self._read(source)

    def _text(self, raw: str) -> None:
        if raw:
            self.segments.append((self._block, self._stack[-1], entities.unescape(raw) if "&" in raw else raw))

    def _pop(self, place: int) -> None:
        """Close all that is open from a place of the stack on."""
        while len(self._stack) > place:
            tag = self.tag[self._stack.pop()]
            self._open[tag].pop()
            if tag in BLOCK:
                self._block += 1

    def _nearest(self, names: frozenset) -> int:
        return max((self._open[n][-1] for n in names if self._open.get(n)), default=-1)

    def _close(self, names: frozenset, scope: frozenset) -> None:
        """Close the nearest open element among ``names`` unless one of ``scope`` stands between."""
        place = self._nearest(names)
        if place >= 0 and place > self._nearest(scope):
            self._pop(place)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and self._open.get(tag):
            return
        if tag in CLOSES_P:
            self._close(frozenset(["p"]), P_SCOPE)
        if tag in SIBLING_CLOSE:
            self._close(*SIBLING_CLOSE[tag])
        if tag in BLOCK:
            self._block += 1
        elif tag in CELL or tag == "br":
            self.segments.append((self._block, self._stack[-1], " "))
        if tag in VOID:
            if tag == "hr":
                self._block += 1
            return
        self.tag.append(tag)
        self.parent.append(self._stack[-1])
        cut, hinted = _cut_off(tag, attributes, bool(self._open.get("article") or self._open.get("main")))
        self.cut.append(cut)
        self.hinted.append(hinted)
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append(len(self.tag) - 1)

    def _end(self, tag: str) -> None:
        if self._open.get(tag) and tag not in ("html", "body"):
            self._pop(self._open[tag][-1])

    def _read(self, source: str) -> None:
        at, last = 0, source.rfind(">")
        search = TOKEN.search if last >= 0 else COMMENT.search
        while m := search(source, at):
            self._text(source[at : m.start()])
            at = m.end()
            if at > last:  # no tag can end from here on
                search = COMMENT.search
            elif m.re is TOKEN and m[2] and m[3] is None:
                search = LOOSE.search
            if m.re is COMMENT or not m[2]:
                continue
            attributes = m[3] or m[4] or ""
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            elif tag in RAW:
                if not attributes.endswith("/") or tag in ("script", "style", "textarea", "title"):
                    end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                    at = end.end() if end else len(source)
            else:
                self._start(tag, attributes)
        self._text(source[at:])


class _Sizes:
    """Characters, tags, link characters and link tags of each node's live subtree; ``own``: of its direct text."""

    def __init__(self, page: _Page, dead: list[bool], linked: list[bool]):
        n = len(page.tag)
        self.chars, self.tags, self.link_chars, self.link_tags, self.own = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        for _, node, text in page.segments:
            if not dead[node]:
                size = sum(map(len, text.split()))
                self.chars[node] += size
                self.own[node] += size
                if linked[node]:
                    self.link_chars[node] += size
        for i in range(n - 1, 0, -1):
            if not dead[i]:
                up = page.parent[i]
                self.chars[up] += self.chars[i]
                self.tags[up] += self.tags[i] + 1
                self.link_chars[up] += self.link_chars[i]
                self.link_tags[up] += self.link_tags[i] + (page.tag[i] == "a")


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, page_chars: int, page_link_chars: int) -> float:
    """Characters per tag, scaled by a logarithm whose argument falls and whose base grows with the share of links."""
    if not chars:
        return 0.0
    tags, plain = max(1, tags), max(1, chars - link_chars)
    base = math.log(chars / plain * link_chars + page_link_chars / max(1, page_chars) * chars + math.e)
    value = chars / max(1, link_chars) * tags / max(1, link_tags)
    # The base is at least 1; just above 1 the logarithm to it would explode.
    return chars / tags * math.log(max(value, 1.0)) / math.log(max(base, 1.0001) + 1)


def _inherited(page: _Page, flags: list[bool]) -> list[bool]:
    flags = flags[:]
    for i in range(1, len(flags)):
        flags[i] = flags[i] or flags[page.parent[i]]
    return flags


def _void_hints(page: _Page, dead: list[bool]) -> None:
    """Take back hints on wrappers; see the module's text."""
    n = len(page.tag)
    hinted = [i for i in range(n) if page.hinted[i] and not dead[i]]
    if not hinted:
        return
    chars, ends = _Sizes(page, dead, dead).chars, list(range(1, n + 1))
    for i in range(n - 1, 0, -1):
        ends[page.parent[i]] = max(ends[page.parent[i]], ends[i])
    whole = max((i for i in range(n) if page.tag[i] in ("article", "main") and not dead[i] and chars[i]), key=lambda i: (chars[i], -i), default=None)
    for i in hinted:
        if whole is not None and i < whole < ends[i]:
            page.hinted[i] = False
    covered = _inherited(page, page.hinted)
    for i in hinted:
        # Without the outermost hinted elements too little would be left.
        if page.hinted[i] and not covered[page.parent[i]] and 4 * (chars[0] - chars[i]) < chars[0]:
            if whole is None or page.tag[whole] == "main" and whole < i < ends[whole]:
                page.hinted[i] = False


def densities(page: _Page, dead: list[bool], hinted: list[bool]) -> tuple[list[float], list[float], _Sizes]:
    """Density and density sum of each node, and the sizes behind them; the text of hinted nodes counts as link text."""
    n = len(page.tag)
    linked = _inherited(page, [hinted[i] or page.tag[i] == "a" for i in range(n)])
    sizes = _Sizes(page, dead, linked)
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if not dead[i]:
            density[i] = composite_density(sizes.chars[i], sizes.tags[i], sizes.link_chars[i], sizes.link_tags[i], sizes.chars[0], sizes.link_chars[0])
            # A subtree of nothing but links or hinted text has no density, whatever its tags.
            if sizes.link_chars[i] == sizes.chars[i]:
                density[i] = 0.0
            if i:
                sums[page.parent[i]] += density[i]
    return density, sums, sizes


def _select(page: _Page, dead: list[bool]) -> list[bool]:
    """Nodes whose direct text is content."""
    n = len(page.tag)
    hinted = _inherited(page, page.hinted)
    density, sums, sizes = densities(page, dead, hinted)
    if not sizes.chars[0]:
        return [False] * n
    if sizes.link_chars[0] == sizes.chars[0]:  # nothing but links or hinted text: all there is
        return [not d for d in dead]
    core = max((i for i in range(n) if not dead[i]), key=lambda i: (sums[i], -i))
    if sums[core] <= 0:
        core = max((i for i in range(n) if not dead[i]), key=lambda i: (density[i], -i))
    path = [core]
    while page.parent[path[-1]] >= 0 and page.tag[path[-1]] != "body":
        path.append(page.parent[path[-1]])
    threshold = min(density[i] for i in path)
    # The core's own article or main, the outermost: from there down small densities count as well.
    home = next((i for i in reversed(path) if page.tag[i] in ("article", "main")), core)
    on_path, within = set(path), set(path[: path.index(home) + 1])
    kept, whole = [False] * n, [False] * n
    for i in path:
        least = 0.0 if i in within else threshold
        kept[i] = not dead[i] and sizes.own[i] > least
    whole[core] = True
    for i in range(1, n):
        up = page.parent[i]
        if dead[i] or hinted[i]:
            continue
        if whole[up]:
            whole[i] = kept[i] = True
        elif up in on_path and i not in on_path:
            whole[i] = kept[i] = density[i] > 0 if up in within else density[i] >= threshold and density[i] > 0
    kept[core] = True
    return kept


def main_text(source: str | None) -> str:
    """Main text of one page: blocks in page order joined by an empty line."""
    if not source:
        return ""
    page = _Page(source)
    dead = _inherited(page, page.cut)
    forms = [i for i in range(len(dead)) if page.tag[i] == "form" and not dead[i]]
    if forms:
        # Some publishing systems wrap the whole page in a form.
        chars = _Sizes(page, dead, dead).chars
        for i in forms:
            dead[i] = 2 * chars[i] < chars[0]
        dead = _inherited(page, dead)
    _void_hints(page, dead)
    kept = _select(page, dead)
    blocks: list[str] = []
    now, parts = -1, []
    for number, node, text in page.segments:
        if kept[node]:
            if number != now:
                blocks.append(" ".join("".join(parts).split()))
                now, parts = number, []
            parts.append(text)
    blocks.append(" ".join("".join(parts).split()))
    return "\n\n".join(b for b in blocks if b)


def extract_main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep``, ``text`` and ``n_chars`` for every row of ``pages``; no shuffle, one pass over the scan."""
    kinds = dict(pages.dtypes)

    def run(slices):
        for rows in slices:
            texts = [main_text(h) for h in rows[html]]
            yield {c: rows[c] for c in keep} | {"text": texts, "n_chars": [len(t) for t in texts]}

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string", "n_chars bigint"])
    return arrow_map(pages.select(*keep, html), run, schema, slice_rows=64)
