"""Main text of web pages by tree scoring.

Paragraphs give points for length and commas to their ancestors: all to the parent, half to the
grandparent, less above. A container's points are discounted by its share of link text. The
best container is kept, widened to the `article` or `main` around it, with siblings that score well,
read as text, or head it. Menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and comments are left out wherever they stand. A class that merely contains one of `LOOSE_NAMES` (`share-price`) leaves
an element out only if it is short or mostly links. Lists of links are menus, but in an `article` they are its own.

Blocks are joined by two line ends; white space in a block becomes one space.

Defined cases: a null or empty page, and one without visible text, give an empty text; text
outside any tag is a block; unclosed and stray tags are tolerated, in time that follows the length of the page;
nesting depth is not limited; of containers with equal scores the first is taken; rows that repeat are rows of their own;
other columns pass through, but for those named like the results, which are replaced.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.sources.shipping import ship_package

_TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg object".split())
BLOCK = frozenset(
    "address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead tr ul".split()
)
# A start tag of the key ends open elements of these names, up to a border.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
BORDER = frozenset("ul ol dl table select body html div section article main".split())
CLOSABLE = frozenset("p li dt dd option tr td th".split())
DROPPED_TAGS = frozenset(
    "head nav footer aside form button select option input menu dialog label datalist progress meter audio video "
    "canvas search".split()
)
# Of these, a name that is only part of a class (`share-price`) drops what is short or mostly links.
LOOSE_NAMES = frozenset("header notice notices overlay promotion recommended related reply replies respond share sharing skip social".split())
LOOSE_TEXT, LOOSE_LINKS = 200, 0.3
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adslot banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices "
    "notification overlay paywall popup promo promoted promotion related recommended respond replies reply share sharing sidebar "
    "sidebars signup skip skyscraper social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
CONTENT_NAMES = frozenset("article body content entry main post story text".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(text)}


def _unwanted(tag: str, attributes: dict[str, str], in_article: bool) -> bool | None:
    """Whether an element is dropped for what it is; None if that depends on its text and links."""
    if tag in DROPPED_TAGS or (tag == "header" and not in_article):
        return True
    if not attributes:
        return False
    if attributes.get("role", "").lower() in DROPPED_ROLES or "hidden" in attributes:
        return True
    if attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    if names.isspace() or tag in ("html", "body"):
        return False
    parts = {p.lower() for p in _NAME_PART.findall(names)}
    found = parts & DROPPED_NAMES
    if not found or (tag in ("article", "main") and parts & CONTENT_NAMES):
        return False
    sure = found - LOOSE_NAMES or not found.isdisjoint(names.lower().split())
    return True if sure else None


def tokens(html: str):
    """(start, end, closing, name, rest) of comments, declarations (name None) and tags, in order and in linear time.

    A tag ends at the first `>` outside quotes. Where quotes never close, or looking for their end has cost more than a few
    times the page, it ends at the first `>` of all.
    """
    size, last = len(html), html.rfind(">")
    patience = 4 * size + 10_000
    at = html.find("<")
    while at >= 0:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = size if end < 0 else end + 3
            yield at, end, "", None, ""
        elif html.startswith("<![CDATA[", at):
            end = html.find("]]>", at + 9)
            end = size if end < 0 else end + 3
            yield at, end, "", None, ""
        elif at > last:
            return
        elif html[at + 1 : at + 2] in ("!", "?"):
            end = html.find(">", at) + 1
            yield at, end, "", None, ""
        elif (named := _TAG_NAME.match(html, at + 1)) is not None and named.end() <= last:
            first = end = html.find(">", named.end())
            quote, looked = "", named.end()
            while patience > 0 and end >= 0:
                quote = _open_quote(html, looked, end, quote)
                if not quote:
                    break
                close = html.find(quote, end + 1)
                patience -= (close if close >= 0 else size) - end
                if close < 0:
                    end = -1
                    break
                quote, looked = "", close + 1
                end = html.find(">", looked)
            if end < 0 or quote:
                end = first
            yield at, end + 1, named[1], named[2], html[named.end() : end]
            end += 1
        else:
            end = at + 1
        at = html.find("<", end)


def _open_quote(html: str, start: int, end: int, quote: str) -> str:
    """The quote that is open at `end`, if any."""
    at = start
    while True:
        if quote:
            at = html.find(quote, at, end)
            if at < 0:
                return quote
            quote, at = "", at + 1
        double, single = html.find('"', at, end), html.find("'", at, end)
        if double < 0 and single < 0:
            return ""
        at = min(x for x in (double, single) if x >= 0)
        quote, at = html[at], at + 1


class _Page:
    """A page's tree as parallel lists; a child has a larger number than its parent."""

    def __init__(self, html: str):
        self.tag, self.parent, self.dropped = ["#root"], [-1], [False]
        self.items: list[tuple[int, str | None]] = []  # (node, text), or None for a border of blocks
        self.loose: set[int] = set()  # dropped if short or mostly links
        self._read(html)

    def _read(self, html: str) -> None:
        tag, parent, dropped, items = self.tag, self.parent, self.dropped, self.items
        stack, articles = [0], 0
        # open elements by name, and of each border the elements inside it that a start tag may end
        opened: dict[str, int] = {}
        scopes: list[list[int]] = [[]]
        place = 0

        def leave(depth: int) -> bool:
            """Close all from a depth on; whether a block was among them."""
            nonlocal articles
            block = False
            for node in stack[:depth - 1:-1]:
                name = tag[node]
                opened[name] -= 1
                articles -= name == "article"
                block = block or name in BLOCK
                if name in BORDER:
                    scopes.pop()
                elif name in CLOSABLE:
                    scopes[-1].pop()
            del stack[depth:]
            return block

        for begin, end, closing, name, rest in tokens(html):
            if begin < place:
                continue  # inside a script or the like
            if begin > place and not dropped[stack[-1]]:
                items.append((stack[-1], html[place:begin]))
            place = end
            if name is None:
                continue
            name = name.lower()
            if closing:
                if opened.get(name):
                    depth = len(stack) - 1
                    while tag[stack[depth]] != name:
                        depth -= 1
                    if leave(depth):
                        items.append((0, None))
                elif name in BLOCK:
                    items.append((0, None))
                continue
            if name in VOID:
                if name in ("br", "wbr", "img"):
                    items.append((stack[-1], " " if name == "br" else ""))
                elif name == "hr":
                    items.append((0, None))
                continue
            if name in RAW:
                if not rest.rstrip().endswith("/"):
                    found = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, place)
                    place = found.end() if found else len(html)
                continue
            if name in BLOCK:
                items.append((0, None))
                ends = CLOSES.get(name, frozenset())
                cut = next((d for d in scopes[-1] if tag[stack[d]] == "p" or tag[stack[d]] in ends), None)
                if cut is not None:
                    leave(cut)
            top = stack[-1]
            unwanted = dropped[top] or _unwanted(name, _attributes(rest) if rest.strip() else {}, articles > 0)
            if unwanted is None:
                self.loose.add(len(tag))
            tag.append(name)
            parent.append(top)
            dropped.append(bool(unwanted))
            stack.append(len(tag) - 1)
            opened[name] = opened.get(name, 0) + 1
            articles += name == "article"
            if name in BORDER:
                scopes.append([])
            elif name in CLOSABLE:
                scopes[-1].append(len(stack) - 1)
        if place < len(html) and not dropped[stack[-1]]:
            items.append((stack[-1], html[place:]))

    def text(self) -> str:
        tag, parent, dropped = self.tag, self.parent, self.dropped
        n = len(tag)
        own, commas, linked, link_count = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = in_link[parent[i]] or tag[i] == "a"
            link_count[i] = int(tag[i] == "a" and not dropped[i])
        for node, chunk in self.items:
            if chunk:
                size = len(chunk.strip())
                own[node] += size
                commas[node] += chunk.count(",") + chunk.count("，") + chunk.count("、")
                if in_link[node]:
                    linked[node] += size
        total, all_links, all_commas, counts = own[:], linked[:], commas[:], link_count
        for i in range(n - 1, 0, -1):
            p = parent[i]
            total[p] += total[i]
            all_links[p] += all_links[i]
            all_commas[p] += all_commas[i]
            counts[p] += counts[i]
        # lists of links are menus, whatever they are called, but in an article they are its own
        inside = [False] * n
        for i in range(1, n):
            inside[i] = inside[parent[i]] or tag[i] == "article"
            menu = tag[i] in ("ul", "ol", "table", "div") and counts[i] >= 3 and all_links[i] >= 0.9 * total[i] > 0
            loose = i in self.loose and (total[i] < LOOSE_TEXT or all_links[i] >= LOOSE_LINKS * total[i])
            if dropped[parent[i]] or (menu and not inside[i]) or loose:
                dropped[i] = True
        density = [all_links[i] / total[i] if total[i] else 0.0 for i in range(n)]
        score = [0.0] * n
        for i in range(1, n):
            if dropped[i] or not total[i]:
                continue
            if tag[i] in PARAGRAPHS:
                points = 1 + all_commas[i] + min(total[i] / 100, 3)
                above, share = parent[i], 1.0
            elif tag[i] in BLOCK and tag[i] not in HEADINGS and own[i]:
                points = 1 + commas[i] + min(own[i] / 100, 3)
                above, share = i, 1.0
            else:
                continue
            level = 0
            while above > 0 and level < 4:
                score[above] += points * share
                above = parent[above]
                level += 1
                share = 0.5 if level == 1 else 1 / (3 * level)
        weighed = [score[i] * (1 - density[i]) for i in range(n)]
        best = max(range(n), key=lambda i: weighed[i])
        if weighed[best] <= 0:
            best = next((i for i in range(1, n) if tag[i] in ("article", "main") and not dropped[i]), 0)
        kept = [False] * n
        widened = best
        while widened > 0 and tag[widened] not in ("article", "main", "body", "html"):
            widened = parent[widened]
        if tag[widened] in ("article", "main"):
            kept[widened] = True
        else:
            kept[best] = True
            if best and tag[best] not in ("body", "html"):
                self._keep_siblings(best, kept, weighed, total, density)
        for i in range(1, n):
            kept[i] = (kept[i] or kept[parent[i]]) and not dropped[i]
        blocks: list[str] = []
        current: list[str] = []

        def close() -> None:
            block = " ".join(unescape("".join(current)).split())
            if block:
                blocks.append(block)
            current.clear()

        for node, chunk in self.items:
            if chunk is None:
                if current:
                    close()
            elif kept[node]:
                current.append(chunk)
        close()
        return "\n\n".join(blocks)

    def _keep_siblings(self, best, kept, weighed, total, density) -> None:
        least = max(10.0, 0.2 * weighed[best])
        for i in range(1, len(self.tag)):
            if self.parent[i] != self.parent[best] or self.dropped[i] or i == best:
                continue
            reads = self.tag[i] == "p" and total[i] > 0 and density[i] < 0.25
            heads = self.tag[i] in HEADINGS or self.tag[i] in ("hgroup", "header")
            if weighed[i] >= least or reads or (heads and density[i] < 0.5):
                kept[i] = True


def main_text(html: str | None) -> str:
    """The main text of one page."""
    return _Page(html).text() if html else ""


def extract_text(df: DataFrame, html: str = "html", to: str = "text") -> DataFrame:
    """Add the main text of every page, and `n_chars`, its code points. One scan, no shuffle."""
    ship_package(df.sparkSession)

    @F.arrow_udf("string")
    def texts(pages: pa.Array) -> pa.Array:
        return pa.array((main_text(page.as_py()) for page in pages), type=pa.string(), size=len(pages))

    return df.withColumn(to, texts(df[html])).withColumn("n_chars", F.length(to).cast("bigint"))
