"""Main text of web pages by tree scoring.

The page is parsed into a tree that closes what authors leave open. Each paragraph passes points, one and one more for
each comma and each hundred characters up to three, to its parent, half of that to the grandparent and a third beyond;
a container's points are discounted by its link density. The best container is kept, with those siblings that score a
fifth of it. Menus, headers and footers of the page, sidebars, notices, adverts, forms, comments of readers, scripts
and styles are left out wherever they stand, by their tag, role, or the words of their class and id; a wrapper around the
article that has such a word (has-sidebar, no-comments) is told by its share of the page's text and is not.

Edge cases: a null or empty page has an empty text; unclosed tags, comments and quotes end with the page; deep nesting
needs no recursion; a page of any length is taken whole; repeated rows give repeated results; further columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import common

#: Fixed sets of HTML: elements without content, those whose content is no markup, and those that stand in a line.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements whose content is never main text.
NEVER = set("script style noscript template nav aside footer form button select option input textarea iframe svg canvas object embed audio video dialog menu head title link meta".split())
PARAGRAPH = set("p pre td blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
#: A start tag of the first kind ends an open element of the second, within the elements that bound it.
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"})}
#: Words of class and id that name what is not main text.
HINTS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent copyright disqus footer gdpr hidden masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion promoted recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
ROLES = set("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
KEEP = set("html body article main".split())

TAG = re.compile(r"<(?:!--(?:.*?--!?>|.*\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z))", re.S)
MARKS = re.compile(r"""(?:^|\s|["'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")


#: Words of class and id that name a container of the article, and what such words say with a hint: no-comments, has-sidebar.
HOLDERS = set("article body content entry has main no page post primary with wrap wrapper".split())
#: Words among HINTS that name what readers wrote.
READERS = set("comment comments commentlist disqus replies reply respond".split())
#: What an element is by its tag and attributes: main text perhaps, none, none by its name, so but named a holder too, or what
#: readers wrote by its name.
OPEN, OUT, NAMED, HOLDER, WRITTEN = range(5)


def dropped(tag: str, attributes: str) -> int:
    if tag in NEVER:
        return OUT
    if not attributes or tag in KEEP and "hidden" not in attributes.lower():
        return OPEN
    hints, holder, readers = False, False, False
    for name, a, b, c in MARKS.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return OUT
        if name == "role":
            if tag not in KEEP and value in ROLES:
                return OUT
        elif tag not in KEEP:
            words = SPLIT.split(value)
            hints = hints or not HINTS.isdisjoint(words)
            holder = holder or not HOLDERS.isdisjoint(words)
            readers = readers or not READERS.isdisjoint(words)
    return OPEN if not hints else HOLDER if holder else WRITTEN if readers else NAMED


class Tree:
    """Nodes as parallel lists; items are (node, text) in page order, a text of None ends a block."""

    def __init__(self, page: str):
        self.tag, self.parent, self.kind = ["#"], [-1], [OPEN]
        self.items: list[tuple[int, str | None]] = []
        self.parse(page)

    def parse(self, page: str) -> None:
        stack, at, items, n = [0], 0, self.items, len(page)
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                items.append((stack[-1], page[at:lt]))
            if lt == n:
                break
            m = TAG.match(page, lt)
            if not m:
                items.append((stack[-1], "<"))
                at = lt + 1
                continue
            at = m.end()
            close, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if close:
                self.close(stack, tag)
                continue
            if tag in ENDS_P:
                self.leave(stack, {"p"}, {"table", "td", "th", "button", "body", "article", "section", "div"})
            if tag in SAME:
                self.leave(stack, *SAME[tag])
            node = len(self.tag)
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.kind.append(dropped(tag, rest))
            if tag not in INLINE:
                items.append((stack[-1], None))
            if tag in VOID:
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                if tag == "textarea" or tag == "title":
                    items.append((node, page[at : end.start() if end else n]))
                at = end.end() if end else n
                continue
            stack.append(node)

    def close(self, stack: list[int], tag: str) -> None:
        if tag not in INLINE:
            self.items.append((stack[-1], None))
        for i in range(len(stack) - 1, 0, -1):
            open_tag = self.tag[stack[i]]
            if open_tag == tag:
                del stack[i:]
                return
            if tag in INLINE and open_tag not in INLINE or open_tag in ("td", "th") and tag not in ("tr", "table", "tbody", "thead", "tfoot", "body", "html"):
                return

    def leave(self, stack: list[int], tags: set[str], bound: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if self.tag[stack[i]] in tags:
                del stack[i:]
                return
            if self.tag[stack[i]] in bound:
                return


def wrappers(t: Tree, drop: list[bool]) -> set[int]:
    """Elements named like what is left out that are around the main text: they hold two thirds of the page's text, and are
    named like a holder too, have the page's article or first heading in them, or lie in the article themselves, are not what
    readers wrote, and are links by half at most."""
    n = len(t.tag)
    size, links, titled = [0] * n, [0] * n, [tag in ("article", "main", "h1") for tag in t.tag]
    within, link = [False] * n, [False] * n
    for i in range(1, n):
        within[i] = within[t.parent[i]] or t.tag[t.parent[i]] in ("article", "main")
        link[i] = link[t.parent[i]] or t.tag[i] == "a"
    for node, text in t.items:
        if text and not drop[node] and not text.isspace():
            size[node] += len(text)
            links[node] += len(text) * link[node]
    for i in range(n - 1, 0, -1):
        p = t.parent[i]
        size[p] += size[i]
        links[p] += links[i]
        titled[p] = titled[p] or titled[i] and not drop[i]
    inside = lambda i: within[i] and t.kind[i] == NAMED and 2 * links[i] <= size[i]
    return {i for i in range(n) if t.kind[i] >= NAMED and 3 * size[i] >= 2 * size[0] and (titled[i] or t.kind[i] == HOLDER or inside(i))}


def extract(page: str) -> str:
    """The main text: inline text joined, blocks joined by one space, white space collapsed."""
    if not page:
        return ""
    t = Tree(page)
    n = len(t.tag)
    drop = [k == OUT for k in t.kind]
    first_article = [False] * n
    for i in range(1, n):  # parents come before children
        p = t.parent[i]
        if t.tag[i] == "header":  # of the page, not of an article
            drop[i] = drop[i] or not first_article[p]
        drop[i] = drop[i] or drop[p]
        first_article[i] = first_article[p] or t.tag[i] in ("article", "main")
    if any(k >= NAMED for k in t.kind):
        wraps = wrappers(t, drop)
        for i in range(1, n):
            drop[i] = drop[i] or drop[t.parent[i]] or t.kind[i] >= NAMED and i not in wraps
    depth_link = [False] * n
    for i in range(1, n):
        p = t.parent[i]
        depth_link[i] = depth_link[p] or t.tag[i] == "a"
    size, links, commas = [0] * n, [0] * n, [0] * n
    texts: list[tuple[int, str | None]] = []
    for node, text in t.items:
        if drop[node]:
            continue
        if text is None:
            texts.append((node, None))
            continue
        if "&" in text:
            text = html.unescape(text)
        texts.append((node, text))
        k = len(text) if not text.isspace() else 0
        size[node] += k
        commas[node] += text.count(",") + text.count("、") + text.count("，") + text.count("،")
        if depth_link[node]:
            links[node] += k
    for i in range(n - 1, 0, -1):
        p = t.parent[i]
        size[p] += size[i]
        links[p] += links[i]
        if t.tag[i] in INLINE or t.tag[i] == "br":
            commas[p] += commas[i]
    points = [0.0] * n
    own = [0] * n
    for node, text in texts:
        if text is not None and not text.isspace():
            while node and t.tag[node] in INLINE:
                node = t.parent[node]
            own[node] += len(text)
    for i in range(1, n):
        if own[i] and not drop[i]:
            gain = 1 + commas[i] + min(size[i] // 100, 3)
            # a container with text of its own is a paragraph to itself
            up, share = (t.parent[i] if t.tag[i] in PARAGRAPH else i), 1.0
            level = 1
            while up > 0 and level <= 3:
                points[up] += gain * share
                up, level = t.parent[up], level + 1
                share = 1 / level
    best, top = 0, 0.0
    for i in range(1, n):
        if points[i] and not drop[i] and t.tag[i] not in PARAGRAPH - {"td", "blockquote"}:
            value = points[i] * (1 - links[i] / max(1, size[i]))
            if value > top:
                best, top = i, value
    if best and t.tag[best] not in ("article", "main"):  # a named article around it is the container meant
        up = t.parent[best]
        while up > 0:
            if t.tag[up] in ("article", "main"):
                best = up
            up = t.parent[up]
    kept = {best}
    if best:
        for i in range(1, n):
            if t.parent[i] == t.parent[best] and i != best and not drop[i] and t.tag[best] not in ("body", "html"):
                density = links[i] / max(1, size[i])
                if points[i] * (1 - density) >= max(3.0, 0.2 * top) or t.tag[i] == "p" and size[i] > 80 and density < 0.25:
                    kept.add(i)
    inside = [False] * n
    for i in range(n):
        inside[i] = i in kept or i > 0 and inside[t.parent[i]]
    return " ".join("".join([" " if text is None else text for node, text in texts if inside[node] or text is None]).split())


def main_text(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with text and n_chars instead of html."""

    def run(batches):
        for b in common.slices(batches, "html"):
            out = [extract(p) for p in common.texts(b, "html")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(common.table(spark, sf_dir, "pages"))
