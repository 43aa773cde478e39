"""The main text of web pages, by tree scoring.

A page becomes a tree, as forgiving as browsers make it. What its tag, role or name says to be a menu, header, footer, sidebar, notice,
advert, form or comment is cut off. Each paragraph earns points for length and commas, less for what of it is links, and passes
them to its ancestors, fewer with each level. The best container is kept, and those of its siblings that look like
it. A page is one row and needs no other, so there is no shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlake.llm.common import lean, rows_of, ship, small_batches

ship(__name__)

#: Elements open at once; what is nested deeper belongs to the last of them, as in browsers.
DEEPEST = 512
#: Points of a paragraph: for each so many characters one, and so many at most; one more from so many on.
POINT_CHARS, MOST_POINTS, FULL_CHARS = 100, 3.0, 25
#: Siblings of the best container need this share of its score.
SIBLING = 0.2
#: From so much of it being links, and so many of them, a list or box is a menu.
MENU_SHARE, MENU_LINKS = 0.75, 3

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea title noembed noframes xmp svg math object audio video canvas select".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What a start tag ends if it is open: (these, but not beyond those).
ENDS = (
    {"li": ({"li"}, {"ul", "ol", "menu", "table"}), "tr": ({"tr", "td", "th"}, {"table"})}
    | dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, {"dl", "table"}))
    | dict.fromkeys(("td", "th"), ({"td", "th"}, {"tr", "table"}))
    | dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}))
)
CELLS = {"td", "th", "caption", "table"}

CUT_TAGS = set("nav footer aside form dialog button menu fieldset search head".split())
CUT_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status".split())
#: Words of a class or id that name what is no part of an article; those with a star may go on.
CUT_NAMES = (
    "ad ads advert* adsense adslot adbox adunit sponsor* promo promos promotion* promoted banner* outbrain taboola "
    "comment* disqus respond replies reply discussion feedback "
    "cookie cookies cookiebar consent gdpr notice notices notification* alert alerts popup* modal* overlay* paywall newsletter* subscribe* subscription* signup "
    "nav navbar navigation navi menu menus submenu breadcrumb* pagination pager sidebar* aside rail widget widgets toolbar topbar masthead header footer foot copyright "
    "share sharing social related recommend* teaser teasers trending login search searchbox skip skiplink hidden"
)
_cut_words = {x for x in CUT_NAMES.split() if not x.endswith("*")}
_cut_starts = tuple(x[:-1] for x in CUT_NAMES.split() if x.endswith("*"))
#: Words before such a word that make it say something of a container of the article.
MODIFIERS = {"has", "with", "no", "without", "show", "hide", "under", "below", "fixed"}
GOOD_NAMES = set("article articlebody body content entry hentry main page post story text blog".split())
CONTAINERS = {"article", "main"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_raw_ends = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}


class Tree:
    """Elements in the order of their start tags; 0 is the page. children has element numbers, texts, and None for a line break."""

    def __init__(self, page: str) -> None:
        self.tags, self.parents, self.attributes, self.children = ["html"], [-1], [""], [[]]
        self._open = [0]
        at, n, seen = 0, len(page), _TAG.search
        while at < n:
            found = seen(page, at)
            if found is None:
                self._text(page[at:])
                break
            if found.start() > at:
                self._text(page[at : found.start()])
            at = found.end()
            if name := found[2]:
                name = name.lower()
                if found[1]:
                    self._end(name)
                elif name in RAW:
                    if not found[3].rstrip().endswith("/") or name in ("script", "style", "title", "textarea"):
                        over = _raw_ends[name].search(page, at)
                        at = over.end() if over else n
                else:
                    self._start(name, found[3])

    def _text(self, text: str) -> None:
        self.children[self._open[-1]].append(html.unescape(text) if "&" in text else text)

    def _pop_to(self, names: set[str], stop: set[str]) -> None:
        """Close what is open down to the lowest of `names` above the first of `stop`."""
        lowest = 0
        for i in range(len(self._open) - 1, 0, -1):
            tag = self.tags[self._open[i]]
            if tag in stop:
                break
            if tag in names:
                lowest = i
        if lowest:
            del self._open[lowest:]

    def _start(self, name: str, attributes: str) -> None:
        if name in ("html", "body"):
            if attributes and name == "body":
                self.attributes[0] += attributes
            return
        if name == "br":
            self.children[self._open[-1]].append(None)
            return
        if name in BLOCK:
            self._pop_to({"p"}, CELLS)
            if name in HEADING and self.tags[self._open[-1]] in HEADING:
                self._open.pop()
        if name in ENDS:
            self._pop_to(*ENDS[name])
        number = len(self.tags)
        self.tags.append(name)
        self.parents.append(self._open[-1])
        self.attributes.append(attributes)
        self.children.append([])
        self.children[self._open[-1]].append(number)
        if name not in VOID and len(self._open) < DEEPEST and not (attributes.endswith("/") and name not in BLOCK and "=" not in attributes):
            self._open.append(number)

    def _end(self, name: str) -> None:
        stop = CELLS - {name} if name not in ("table", "tr", "tbody", "thead", "tfoot") else {"table"} - {name}
        for i in range(len(self._open) - 1, 0, -1):
            tag = self.tags[self._open[i]]
            if tag == name:
                del self._open[i:]
                return
            if tag in stop or (name not in BLOCK and name not in CELLS and tag in BLOCK):
                return


def _named(attributes: str) -> tuple[list[str], bool]:
    """The words of class and id, those behind one of MODIFIERS with it; whether other attributes say that it is no part of the text."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    words = []
    for name in (found.get("class", "") + " " + found.get("id", "")).split():
        before = ""
        for word in map(str.lower, _NAME_WORDS.findall(name)):
            words.append(f"{before} {word}" if before in MODIFIERS else word)
            before = word
    unseen = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_UNSEEN.search(found.get("style", "")))
    return words, unseen or found.get("role", "").lower() in CUT_ROLES


class Page:
    def __init__(self, text: str) -> None:
        self.tree = tree = Tree(text)
        self.named = [_named(x) if x else ([], False) for x in tree.attributes]
        self.words = [words for words, _ in self.named]
        by_name = self._cut_off(set())
        if by_name:
            self._cut_off(self._spared(by_name))
        self._measure()

    def _cut_off(self, spared: set[int]) -> set[int]:
        """Mark what is cut; the elements, not in what was cut before, that only their names cut, but for the spared ones."""
        tree, n = self.tree, len(self.tree.tags)
        self.cut, by_name, inside = [False] * n, set(), [False] * n  # inside an article or main element
        for i in range(1, n):
            tag, up = tree.tags[i], tree.parents[i]
            inside[i] = inside[up] or tag in CONTAINERS
            words, marked = self.named[i]
            if self.cut[up] or marked or tag in CUT_TAGS or (tag == "header" and not inside[up]):
                self.cut[i] = True
            elif words and i not in spared and tag not in HEADING:
                starts = ("comment",) if tag in CONTAINERS else _cut_starts
                if any(x.startswith(starts) or (tag not in CONTAINERS and x in _cut_words) for x in words if " " not in x):
                    self.cut[i] = True
                    by_name.add(i)
        return by_name

    def _spared(self, by_name: set[int]) -> set[int]:
        """Boxes that hold the page's article, or its first heading if no name there says that it heads the site."""
        tree, spared = self.tree, set()
        first = next((i for i, tag in enumerate(tree.tags) if tag == "h1"), -1)
        for i, tag in enumerate(tree.tags):
            article = tag in CONTAINERS and i not in by_name
            up = i if article or i == first else 0
            while up > 0:
                if up in by_name and not any(x.startswith("comment") or (not article and x.startswith(("header", "masthead", "banner", "topbar"))) for x in self.words[up]):
                    spared.add(up)
                up = tree.parents[up]
        return spared

    def _measure(self) -> None:
        """chars, linked (of these), links and commas of each subtree without what is cut; whether it has blocks."""
        tree, n = self.tree, len(self.tree.tags)
        self.chars, self.linked, self.links, self.commas, self.blocks, self.direct = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n, [0] * n
        for i in range(n - 1, -1, -1):
            if self.cut[i]:
                continue
            own = " ".join([x for x in tree.children[i] if isinstance(x, str)])
            self.direct[i] = size = len("".join(own.split()))
            self.chars[i] += size
            self.commas[i] += own.count(",") + own.count("、") + own.count("，")
            tag, up = tree.tags[i], tree.parents[i]
            if tag == "a":
                self.linked[i], self.links[i] = self.chars[i], self.links[i] + 1
            if up >= 0:
                self.chars[up] += self.chars[i]
                self.linked[up] += self.linked[i]
                self.links[up] += self.links[i]
                self.commas[up] += self.commas[i]
                self.blocks[up] |= self.blocks[i] or tag in BLOCK

    def link_share(self, i: int) -> float:
        return self.linked[i] / self.chars[i] if self.chars[i] else 0.0

    def scores(self) -> list[float]:
        tree, n = self.tree, len(self.tree.tags)
        score = [0.0] * n
        for i in range(1, n):
            if self.cut[i] or not self.chars[i] or tree.tags[i] not in BLOCK and tree.tags[i] not in CELLS:
                continue
            whole = not self.blocks[i] and tree.tags[i] not in HEADING and tree.tags[i] != "li"
            if not whole and not (self.direct[i] and self.blocks[i]):
                continue
            chars = self.chars[i] if whole else self.direct[i]
            commas = self.commas[i] if whole else 0
            points = (min(chars / FULL_CHARS, 1.0) + commas + min(chars / POINT_CHARS, MOST_POINTS)) * (1 - self.link_share(i))
            share, up = 1.0, tree.parents[i] if whole else i
            for level in range(4):
                if up < 0:
                    break
                score[up] += points * share
                up, share = tree.parents[up], 1 / (2 + level)
        for i in range(n):
            if score[i]:
                score[i] += 25.0 * (tree.tags[i] in CONTAINERS) + 12.0 * any(x in GOOD_NAMES for x in self.words[i])
                score[i] *= 1 - self.link_share(i)
        return score

    def chosen(self) -> list[int]:
        """The best container, or the article around it, and its siblings that look like it, in page order."""
        tree, score = self.tree, self.scores()
        best = max(range(len(score)), key=lambda i: (score[i], -i))
        if score[best] <= 0:
            whole = [i for i in range(1, len(score)) if tree.tags[i] in CONTAINERS and self.chars[i] and not self.cut[i]]
            return whole[:1] or [0]
        up = best
        while up > 0 and tree.tags[up] != "article":
            up = tree.parents[up]
        if up <= 0:
            up = best
            while up > 0 and tree.tags[up] != "main":
                up = tree.parents[up]
        if up > 0:
            best = up
        if best == 0:
            return [0]
        if tree.tags[best] == "main":
            return [best]
        beside = [x for x in tree.children[tree.parents[best]] if isinstance(x, int) and not self.cut[x] and self.chars[x]]
        out, least = [], max(10.0, SIBLING * score[best])
        around = tree.tags[best] not in CONTAINERS
        for x in beside:
            tag, share = tree.tags[x], self.link_share(x)
            like = x == best or (score[x] >= least and share < 0.5)
            if around and not like:
                if tag == "p":
                    like = share < 0.25 if self.chars[x] > 80 else not self.links[x]
                elif tag in ("blockquote", "pre", "ul", "ol", "dl", "table", "figure"):
                    like = share < 0.25
                elif tag in HEADING:
                    like = share < 0.25
            if like:
                out.append(x)
        while out and tree.tags[out[-1]] in HEADING and out[-1] != best:  # a heading of nothing that is kept
            out.pop()
        return out

    def _menu(self, i: int) -> bool:
        return self.tree.tags[i] in ("ul", "ol", "div", "section", "table", "dl", "p") and self.links[i] >= MENU_LINKS and self.link_share(i) >= MENU_SHARE

    def text(self) -> str:
        """The blocks of what is chosen, one line each."""
        tree, out, held = self.tree, [], []
        breaks = 0

        def flush() -> None:
            if line := " ".join("".join(held).split()):
                out.append(line)
            held.clear()

        for top in self.chosen():
            flush()
            head = tree.tags[top] == "header"
            todo: list[tuple[int, int, bool]] = [(top, 0, head)]
            while todo:
                i, at, head = todo.pop()
                children, tag = tree.children[i], tree.tags[i]
                if at == 0 and tag in BLOCK:
                    flush()
                while at < len(children):
                    child = children[at]
                    at += 1
                    if child is None:
                        held.append(" ")
                        breaks += 1
                        if breaks > 1:
                            flush()
                    elif isinstance(child, str):
                        if not head or tag in HEADING:
                            held.append(child)
                        if breaks and not child.isspace():
                            breaks = 0
                    elif not self.cut[child] and not (child != top and self._menu(child)):
                        if tree.tags[child] in CELLS:
                            held.append(" ")
                        todo.append((i, at, head))
                        # of an article's own header its headings are kept
                        todo.append((child, 0, (head or tree.tags[child] == "header") and tree.tags[child] not in HEADING))
                        break
                else:
                    if tag in BLOCK:
                        flush()
                        breaks = 0
        flush()
        return "\n".join(out)


def main_text(page: str) -> str:
    """The main text of one page."""
    return Page(page).text()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py() or "") for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html).

    Blocks are joined by a line feed; white space in a block is one space, two line breaks in a row end one. A page without text, a null
    and an empty one give the empty text. Pages of any length are read whole; repeated rows and null ids are rows of their own; other
    columns stay behind; of two containers of one score the earlier wins. An empty table gives an empty result.
    """
    small_batches(pages.sparkSession)
    rows = rows_of(pages, page_id=F.col("page_id").cast("long"), url=F.col("url").cast("string"), html=F.col("html"))
    return rows.mapInArrow(lean(_extract), "page_id bigint, url string, text string, n_chars bigint")
