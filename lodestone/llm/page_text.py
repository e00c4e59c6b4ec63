"""Main text of web pages by tree scoring: paragraphs pass points for length and
commas to their ancestors, link density takes points off, and the best
container is kept with those of its siblings that read like it."""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import map_arrow

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td"
    " tfoot th thead tr ul br option select button caption".split()
)
DROPPED = frozenset(
    "script style noscript template head nav footer aside form button select option textarea input iframe object"
    " embed applet svg math canvas audio video map menu dialog fieldset label title".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the key ends when one of the values begins inside it.
ENDED_BY = {
    "p": frozenset(
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2"
        " h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dt dd tr td th tbody".split()
    ),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"]),
    "option": frozenset(["option"]),
    "head": frozenset(["body"]),
}
#: An end inside one of these doesn't close what is outside.
SCOPES = {"li": ("ul", "ol"), "td": ("table",), "th": ("table",), "tr": ("table",), "dd": ("dl",), "dt": ("dl",), "p": ()}
UNLIKELY = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments"
    " commentlist consent contentinfo cookie cookies disclaimer disqus footer gdpr header login masthead menu modal"
    " nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion rail"
    " recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored"
    " subscribe subscription toolbar widget widgets".split()
)
LIKELY = frozenset("article body content entry main post story text".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Tree:
    """Elements in page order, as parallel lists; texts with their elements."""

    def __init__(self):
        self.tag, self.parent, self.owner, self.dropped, self.linked, self.main = ["#"], [-1], [0], [False], [False], [False]
        self.texts: list[tuple[int, int, str]] = []  # (element, number of block borders before, text)

    def add(self, tag: str, parent: int, attributes: str) -> int:
        i = len(self.tag)
        in_main = self.main[parent]
        self.tag.append(tag)
        self.parent.append(parent)
        self.owner.append(i if tag in BLOCKS else self.owner[parent])
        self.dropped.append(self.dropped[parent] or tag in DROPPED or unlikely(tag, attributes, in_main))
        self.linked.append(self.linked[parent] or tag == "a")
        self.main.append(in_main or tag in ("article", "main"))
        return i


def unlikely(tag: str, attributes: str, in_main: bool) -> bool:
    """By its attributes, an element that is not part of the article."""
    if tag == "header" and not in_main:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    words: set[str] = set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id"):
            words.update(_WORD.findall(value))
    if tag in ("article", "main") or not words & UNLIKELY:
        return False
    return not words & LIKELY or bool(words & {"comment", "comments", "ad", "ads", "sidebar", "cookie", "footer"})


def parse(page: str) -> Tree:
    tree, stack, borders, at, size = Tree(), [0], 0, 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            tree.texts.append((stack[-1], borders, page[at:]))
            break
        if m.start() > at:
            tree.texts.append((stack[-1], borders, page[at : m.start()]))
        at = m.end()
        closing, tag, attributes = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        if not tag:
            if page.startswith("<![CDATA[", m.start()):
                tree.texts.append((stack[-1], borders, page[m.start() + 9 : m.end() - 3]))
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            borders += 1
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                name = tree.tag[stack[depth]]
                if name == tag:
                    del stack[depth:]
                    break
                if name in SCOPES.get(tag, ()) or name in ("article", "body") and tag not in ("article", "body", "html", "main"):
                    break
            continue
        # what this element ends
        for depth in range(len(stack) - 1, 0, -1):
            name = tree.tag[stack[depth]]
            if tag in ENDED_BY.get(name, ()):
                del stack[depth:]
            elif name in BLOCKS and name not in ("p", "tr", "td", "th", "tbody"):
                break
        element = tree.add(tag, stack[-1], attributes)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            if tag == "noscript" or tag not in DROPPED:
                pass
            at = end.end() if end else size
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(element)
    return tree


def main_text(page: str) -> str:
    tree = parse(page)
    n = len(tree.tag)
    size, link, commas = [0] * n, [0] * n, [0] * n  # of the texts that a block holds itself
    for element, _, text in tree.texts:
        if not tree.dropped[element]:
            length = len(text.strip())
            if length:
                block = tree.owner[element]
                size[block] += length
                commas[block] += text.count(",")
                if tree.linked[element]:
                    link[block] += length
    score = [0.0] * n
    for i in range(n):
        if size[i] and tree.tag[i] not in HEADINGS and not tree.dropped[i]:
            points = (1 + commas[i] + min(size[i] / 100, 3)) * (1 - link[i] / size[i])
            if tree.tag[i] not in ("p", "li", "pre", "td", "blockquote", "dd"):
                score[i] += points
            level, above = 1, tree.parent[i]
            while above >= 0 and level <= 5:
                score[above] += points / (1 if level == 1 else 2 if level == 2 else 3 * level)
                level, above = level + 1, tree.parent[above]
    whole, links, amount = size[:], link[:], [0] * n
    for i in range(n - 1, 0, -1):
        up = tree.parent[i]
        whole[up] += whole[i]
        links[up] += links[i]
        amount[up] += amount[i] + (tree.tag[i] == "a")
    value = [s * (1 - links[i] / whole[i]) if whole[i] else 0.0 for i, s in enumerate(score)]
    best = max(range(n), key=lambda i: (value[i], -i))
    if value[best] <= 0:
        roots = {0}
    else:
        above = best
        while above > 0 and tree.tag[above] not in ("article", "main"):
            above = tree.parent[above]
        best = above if above > 0 else best
        roots = {best}
        for i in range(1, n):
            if tree.parent[i] == tree.parent[best] and i != best and not tree.dropped[i] and whole[i]:
                dense = links[i] / whole[i]
                # beside an article or main, only what is long; else all that reads like the best
                floor, least = (10, 80) if above > 0 else (0, 0)
                alike = value[i] >= max(floor, 0.2 * value[best]) and (above > 0 or dense < 0.25)
                if tree.tag[i] in HEADINGS and i < best or alike or tree.tag[i] == "p" and (whole[i] > least and dense < 0.25):
                    roots.add(i)
    inside, out, block, last = [False] * n, [], [], None
    menu = [False] * n
    for i in range(n):
        up = tree.parent[i]
        inside[i] = i in roots or up >= 0 and inside[up]
        # a list of nothing but links is a menu
        menu[i] = up >= 0 and menu[up] or tree.tag[i] in ("ul", "ol") and amount[i] > 1 and links[i] >= 0.9 * whole[i]
    for element, border, text in tree.texts:
        if inside[element] and not menu[element] and not tree.dropped[element] and not in_header(tree, element):
            if border != last:
                out.append("".join(block))
                block, last = [], border
            block.append(text)
    out.append("".join(block))
    return " ".join(" ".join(entities.unescape(b).split()) for b in out if b.strip()).strip()


def in_header(tree: Tree, element: int) -> bool:
    """Inside an article's header only the headings belong to the text."""
    heading = False
    while element > 0:
        heading |= tree.tag[element] in HEADINGS
        if tree.tag[element] == "header":
            return not heading
        element = tree.parent[element]
    return False


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row of ``pages``: the whole page is parsed.

    White space (of any kind) inside a block becomes one space, blocks are
    joined by one space in page order. A null page has an empty text. Pages that
    break off inside a tag lose that tag only. If no paragraph scores, all text
    outside the dropped elements is kept. No two rows are compared.
    """

    def each(batch):
        texts = [main_text(page or "") for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )

    kinds = dict(pages.dtypes)
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    return map_arrow(pages.select("page_id", "url", "html"), each, schema)
