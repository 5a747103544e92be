"""Main text of web pages by tag-path ratios.

Every text node belongs to its root-to-leaf tag path. Text length (links left out) and punctuation per
node are summed by path, smoothed over the paths in page order, and fused into one number; elements
outside of articles that are named as furniture, and advert-like names anywhere, lower it. Paths at
or above the page's threshold are content, and they choose the nodes: the deepest element that holds
every content node is the container, widened to the article or main element around it, or else to
plain wrappers that hold no furniture. The blocks of the container are the main text, but for

* furniture by tag or role (menus, headers, footers, sidebars, forms, scripts), what is hidden, and
  reader comments,
* elements whose class or id names furniture while no path below them reaches the threshold, or
  nearly all of them is links,
* outside of articles: runs of links, and parts without a content path of a container that holds furniture.

One page is read by one call in one pass, in time and memory in proportion to that page: tags are
found by a scanner that never goes back over what it has read. The Arrow function keeps every other
column on the JVM side and nothing is shuffled.

Defined results: null or empty html gives an empty text; markup that is cut off or unbalanced is
read as far as it goes; a page that is all furniture gives an empty text; very long pages are read
whole; of paths that tie, all are content or none; repeated pages give repeated rows; an empty table
gives an empty result; other columns are never read, so that names that clash do no harm.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kvlake.llm.common import bounded_batches, table

RICH, POOR, NAMED = 5.5, 1.5, 0.001  # log score that is always content, and never; factor of named paths

_NAME = re.compile(r"/?([A-Za-z][A-Za-z0-9:-]*)")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"""([^\s=>/"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_PUNCT = re.compile(r"[.,;:!?…。，！？¿¡\"'()-]")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
_RAW = frozenset("script style title textarea noscript template iframe svg math object select option button".split())
_DROP_TAGS = frozenset("head nav footer aside form menu dialog fieldset".split()) | _RAW
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Names that lower a path anywhere, and names that do so outside of articles only.
_STRONG = frozenset("nav navbar navbars navlinks topnav navigation menu menubar masthead topbar footer sidebar sidebars rail ad ads adv advert adverts advertisement advertisements sponsor sponsored cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login social share sharing breadcrumb breadcrumbs pagination pager toolbar disqus respond promo promotion copyright".split())
_WEAK = frozenset("header aside banner notice notices alert warning related recommended recommendations reply replies discussion widget widgets search".split())
_COMMENTS = frozenset("comment comments commentlist commentlists disqus".split())
_FILLER = frozenset("list lists area section box block wrap wrapper container content inner outer item items group top bottom left right main page site the js id thread threads links link bar row body entry text".split())
_TITLES = frozenset("post entry article story content headline title".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TEXTUAL = _HEADINGS | frozenset("p ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SHIELD = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",)}


class _Scanner:
    """Where tags end, and where raw elements do. What was searched for in vain is not searched for again."""

    def __init__(self, html: str):
        self.html, self.gone, self.failures = html, set(), 0

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """Index of the > that ends the tag whose name ends at ``at``; -1 if there is none. Quotes count after an equals sign."""
        html, to = self.html, at
        while self.failures < 8 and (m := _STOP.search(html, to)):
            if m[0] == ">":
                return m.start()
            to = m.end()
            if html[at : to - 1].rstrip()[-1:] == "=" if to - at < 64 else html[to - 33 : to - 1].rstrip()[-1:] == "=":
                close = self.find(m[0], to)
                if close < 0:
                    break
                to = close + 1
        self.failures += 1
        return self.find(">", at)

    def raw_end(self, tag: str, at: int) -> int:
        """Where the content after the end tag of a raw element begins; -1 if it is never closed."""
        if tag in self.gone:
            return -1
        m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(self.html, at)
        end = self.find(">", m.end()) if m else -1
        if end < 0:
            self.gone.add(tag)
        return end + 1 if end >= 0 else -1


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)} if raw and not raw.isspace() else {}


def _names(tag: str, attrs: dict[str, str]) -> list[str]:
    """Class and id tokens that may name furniture. The id of a heading is an anchor made from its words."""
    if tag in ("body", "html", "main"):
        return []
    return f"{attrs.get('class', '')} {'' if tag == 'article' or tag in _HEADINGS else attrs.get('id', '')}".split()


def _furniture(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether an element is furniture by tag, role or being hidden, or holds comments; inside: it stands in an article."""
    if tag in _DROP_TAGS or tag == "header" and not inside:
        return True
    if not attrs:
        return False
    if attrs.get("role", "").lower() in _DROP_ROLES or attrs.get("aria-hidden") == "true" or "hidden" in attrs:
        return True
    if "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    tokens = _names(tag, attrs)
    return "hidden" in map(str.lower, tokens) or tag != "p" and any(_all_of(t, _COMMENTS) for t in tokens)


def _all_of(token: str, names: frozenset) -> bool:
    """Whether a class or id is made of such names, filler and numbers only."""
    parts = {p.lower() for p in _PART.findall(token)} if token.lower() not in names else {token.lower()}
    return bool(parts & names) and all(p in names or p in _FILLER or p.isdigit() for p in parts)


def _named(tag: str, attrs: dict[str, str], inside: bool) -> int:
    """2 if class or id name an element as furniture, 1 if they hint at it, else 0."""
    tokens = _names(tag, attrs) if "class" in attrs or "id" in attrs else []
    if not tokens or inside and tag in _HEADINGS:
        return 0
    if any(_all_of(t, _STRONG) for t in tokens):
        return 2
    parts = {p.lower() for t in tokens for p in (t, *_PART.findall(t))}
    found = parts & (_STRONG | _WEAK | _COMMENTS)
    if found <= {"header"} and (inside or parts & _TITLES):  # the header of an article holds its title
        return 0
    return (1 if inside else 2) if found else 0


class _Page:
    """Elements (parent, tag, path, in an article) and blocks [element, path, furniture, pieces, link characters, named elements]."""

    def __init__(self, html: str):
        self.parent, self.tag, self.article = [-1], [""], [0]  # article: 2 inside an article, 1 inside main only
        self.paths: dict[tuple, int] = {}
        self.labels: list[tuple[int, float]] = [(-1, 1.0)]  # parent path and factor of each path
        self.blocks: list[list] = []
        self.stack: list[tuple] = [("", 0, 0, False, ())]  # tag, element, path, furniture, named
        self.depth: dict[str, list[int]] = {}  # places of each tag in the stack
        self.current: list | None = None
        self.links = self.named = 0
        self.read(html)

    def read(self, html: str) -> None:
        scan, at, n = _Scanner(html), 0, len(html)
        while at < n:
            lt = html.find("<", at)
            self.text(html[at : lt if lt >= 0 else n])
            if lt < 0:
                return
            at = lt + 1
            m = _NAME.match(html, at)
            if m:
                end = scan.tag_end(m.end())
                if end < 0:
                    return  # cut off
                tag, attrs = m[1].lower(), html[m.end() : end]
                at = end + 1
                if html[lt + 1] == "/":
                    self.close(tag)
                elif tag in _RAW and not attrs.endswith("/"):
                    end = scan.raw_end(tag, at)
                    at = end if end >= 0 else n if tag in ("script", "style") else at
                    self.current = self.current if tag in _INLINE else None
                else:
                    self.open(tag, attrs)
            elif html.startswith("!--", at):
                end = scan.find("-->", at + 1)
                at = end + 3 if end >= 0 else n
            elif html.startswith("![CDATA[", at):
                end = scan.find("]]>", at)
                self.text(html[at + 8 : end if end >= 0 else n].replace("&", "&amp;"))
                at = end + 3 if end >= 0 else n
            elif html.startswith(("!", "?"), at):
                end = scan.find(">", at)
                at = end + 1 if end >= 0 else n
            else:
                self.text("<")

    def last(self, tag: str) -> int:
        places = self.depth.get(tag)
        return places[-1] if places else -1

    def open(self, tag: str, raw: str) -> None:
        if tag == "br":
            self.text(" ")
            return
        if tag not in _INLINE:
            self.current = None
            if self.last("p") >= 0:
                self.close("p")
            if tag in _CLOSES:
                floor = max(self.last(t) for t in _SHIELD.get(tag, ("table",))) + 1
                for t in _CLOSES[tag]:
                    if self.last(t) >= floor:
                        self.close(t, floor)
        if tag in _VOID or raw.endswith("/"):
            return
        _, element, path, bad, soft = self.stack[-1]
        if tag not in _INLINE or raw:
            attrs = _attributes(raw)
            inside = self.article[element]
            article = 2 if tag == "article" or "articlebody" in attrs.get("itemprop", "").lower() else 1 if tag == "main" or attrs.get("role", "").lower() == "main" else 0
            bad = bad or _furniture(tag, attrs, bool(inside or article))
            kind = 0 if bad else _named(tag, attrs, bool(inside))
            if kind:
                self.named += 1
                soft = (*soft, self.named) if len(soft) < 8 else soft
            if tag not in _INLINE:
                self.parent.append(element)
                self.tag.append(tag)
                self.article.append(0 if bad else max(inside, article))
                element = len(self.parent) - 1
            if tag not in _INLINE or kind == 2:
                label = (path, tag, " ".join(sorted(attrs.get("class", "").split())), kind == 2)
                if label not in self.paths:
                    self.paths[label] = len(self.labels)
                    self.labels.append((path, NAMED if kind == 2 else self.labels[path][1]))
                path = self.paths[label]
        self.depth.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, element, path, bad, soft))
        self.links += tag == "a"

    def close(self, tag: str, floor: int = 0) -> None:
        if tag not in _INLINE:
            self.current = None
        at = self.last(tag)
        if at < max(floor, 1) or tag in _INLINE and any(x[0] not in _INLINE for x in self.stack[max(at, len(self.stack) - 64) :]):
            return
        while len(self.stack) > at:
            gone = self.stack.pop()[0]
            self.depth[gone].pop()
            self.links -= gone == "a"

    def text(self, raw: str) -> None:
        if not raw or self.current is None and raw.isspace():
            return
        _, element, path, bad, soft = self.stack[-1]
        now = self.current
        if now is None or now[0] != element or now[1] != path or now[2] != bad or now[5] != soft:
            now = self.current = [element, path, bad, [], 0, soft]
            self.blocks.append(now)
        now[3].append(raw)
        if self.links:
            now[4] += len(raw.strip())

    def under(self, counts: dict[int, float]) -> list[float]:
        """Sums over each element and all below it; parents come before their children."""
        total = [0.0] * len(self.parent)
        for e, n in counts.items():
            total[e] += n
        for e in range(len(self.parent) - 1, 0, -1):
            total[self.parent[e]] += total[e]
        return total


def path_scores(blocks: list[tuple[int, int, float]], factor: dict[int, float]) -> dict[int, float]:
    """Logarithm of the fused, smoothed length and punctuation ratios of every path; blocks give path, characters outside of
    links, and punctuation marks."""
    stats: dict[int, list[float]] = {}
    for path, chars, marks in blocks:
        s = stats.setdefault(path, [0, 0, 0])
        s[0] += chars
        s[1] += marks
        s[2] += 1
    paths = list(stats)
    ratios = [[stats[p][f] / stats[p][2] for p in paths] for f in (0, 1)]
    kernel = [math.exp(-k * k / 2) for k in range(3)]
    out = {}
    for i, p in enumerate(paths):
        fused = factor[p]
        for f in (0, 1):
            near = [(kernel[abs(k)], ratios[f][i + k]) for k in range(-2, 3) if 0 <= i + k < len(paths)]
            smooth = sum(w * v for w, v in near) / sum(w for w, _ in near)
            # smoothing carries a little over to what stands beside rich paths, never more than the path has itself
            fused *= f + 0.75 * ratios[f][i] + 0.25 * min(smooth, ratios[f][i])
        out[p] = math.log1p(fused)
    return out


def main_text(html: str | None) -> str:
    """Blocks of the main content joined by two newlines."""
    if not html:
        return ""
    page = _Page(html)
    blocks = []  # element, path, furniture, text, share of links, named elements
    for element, path, bad, pieces, links, soft in page.blocks:
        if text := " ".join(unescape("".join(pieces)).split()):
            blocks.append((element, path, bad, text, min(1.0, links / len(text)), soft))
    open_ = [b for b in blocks if not b[2]]
    if not open_:
        return ""
    score = path_scores([(path, len(text) * (1 - linked), len(_PUNCT.findall(text)) * (1 - linked)) for _, path, _, text, linked, _ in open_], {b[1]: page.labels[b[1]][1] for b in open_})
    cut = max(min(sum(score.values()) / len(score), RICH), min(POOR, max(score.values())))
    content: dict[int, float] = {}
    for b in open_:
        if score[b[1]] >= cut:
            content[b[0]] = content.get(b[0], 0) + 1
    rich = page.under(content)
    root = 0
    for e in range(1, len(rich)):  # the deepest element that holds all content
        if rich[e] == rich[0]:
            root = e
    box, clean = _widened(page, root, blocks)
    inside = _members(page, box)
    # a name marks furniture where no path below it reaches the threshold, or all of it is links
    named: dict[int, list[float]] = {}
    for element, path, _, text, linked, soft in open_:
        for k in soft:
            n = named.setdefault(k, [0, 0, 0])
            n[0] += score[path] >= cut
            n[1] += linked * len(text)
            n[2] += len(text)
    poor = {k for k, (any_rich, links, chars) in named.items() if not any_rich or links > 0.8 * chars}
    held = [b for b in open_ if inside[b[0]] and poor.isdisjoint(b[5])]
    # what an article holds stays, and a main element without an article is one
    best = max((page.article[b[0]] for b in held), default=0)
    loose = [b for b in held if not best or page.article[b[0]] < best]
    runs: dict[int, list[int]] = {}
    for b in loose:
        n = runs.setdefault(b[1], [0, 0])
        n[0] += 1
        n[1] += b[4] > 0.8
    menus = {p for p, (n, linked) in runs.items() if n >= 3 and linked == n}
    alone = _barren(page, box, rich) if not best and not clean else None
    return "\n\n".join(b[3] for b in held if best and page.article[b[0]] >= best or b[1] not in menus and not (alone and alone[b[0]]))


def _widened(page: _Page, root: int, blocks: list) -> tuple[int, bool]:
    """The outermost article or main element around ``root``, or else the wrappers around it that hold no furniture; and
    whether it holds none."""
    outer, e = 0, root
    while e > 0:
        if page.article[e] and (page.tag[e] in ("article", "main") or not page.article[page.parent[e]]):
            outer = e
        e = page.parent[e]
    if outer:
        return outer, True
    foul: dict[int, float] = {}
    for element, _, bad, _, linked, soft in blocks:
        if bad or soft or linked > 0.5:
            foul[element] = foul.get(element, 0) + 1
    count, e = page.under(foul), root
    while e > 0 and page.tag[e] not in ("body", "html") and (page.tag[e] in _TEXTUAL or page.parent[e] > 0 and page.tag[page.parent[e]] not in ("body", "html") and count[page.parent[e]] == count[e]):
        e = page.parent[e]
    return e, e > 0 and page.tag[e] not in ("body", "html") and not count[e]


def _members(page: _Page, box: int) -> list[bool]:
    """Whether each element is ``box`` or below it."""
    out = [False] * len(page.parent)
    out[box] = True
    for e in range(box + 1, len(out)):
        out[e] = out[page.parent[e]]
    return out


def _barren(page: _Page, box: int, rich: list[float]) -> list[bool]:
    """Whether each element is in a part of ``box`` that is not plain text and holds no content."""
    out = [False] * len(page.parent)
    for e in range(box + 1, len(out)):
        out[e] = out[page.parent[e]] or not rich[e] and page.tag[e] not in _TEXTUAL and page.tag[page.parent[e]] not in _TEXTUAL
    return out


def extract(html: Column) -> Column:
    """Main text of an html column."""
    bounded_batches()

    @F.arrow_udf("string")
    def html_text(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py()) for x in column], pa.string())

    return html_text(html)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", extract(F.col("html")).alias("text")).select("*", F.length("text").cast("long").alias("n_chars"))
