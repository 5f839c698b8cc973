"""Main text of web pages by line-block distribution.

Markup is stripped into one line for each block of text, in page order; scripts, styles, menus, headers,
footers and sidebars by element are left out.  So are blocks whose class, id or role names them as such, as
forms, notices, adverts or reader comments, unless the page needs them: a name is overruled where the block
holds an article with more text than all that is outside named blocks, or, where no article is outside, four
times that text.  Reader comments stay out as long as there is any other text, in article elements too.  The
text lengths (link text apart) are summed over sliding windows of lines.  A region begins at a surge,
where a window's sum passes the threshold, and ends at the dive, where the sums fall to nothing; the
region with the most text is the core.  The result is every remaining line of the outermost article and
main elements of the core, if they hold all of it, or else of the smallest element that does.  If that is
the whole page, it is the core with the other regions that have blocks beside the core's, what stands
between them but is no link, and the article and main elements that the core touches.

Elements are numbered as they open, so an element's descendants are one range of numbers; every step is
linear in the page, whatever its markup.

Defined cases: null and empty pages, and pages without text, have an empty text; unclosed elements end
with their parent, and a boilerplate element that is never closed is read as ordinary text; repeated
rows are extracted one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

_TOKEN = re.compile(
    r"""<(?:!--(?:.*?--!?>|.*)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[!?/][^>]*+>)""", re.S
)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_BODY = re.compile(r"""\brole\s*=\s*["']?(?:main|article)\b|\bitemprop\s*=\s*["']?articleBody\b""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?until)|\bdisplay\s*:\s*none\b|\baria-hidden\s*=\s*["']?true""", re.I)

RAW = frozenset("script style noscript template iframe svg textarea title audio video annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav header footer aside menu dialog button select head".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mo mn ms mtext mrow mfrac msup msub msubsup munder mover munderover msqrt mroot mspace mstyle mpadded semantics object canvas".split()
)
#: Words of class, id and role that mark boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner banners sponsor sponsored promo promotion promoted nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer header masthead "
    "topbar toolbar cookie cookies consent gdpr notice notices alert alerts disclaimer popup modal overlay newsletter subscribe subscription signup login search comment comments commentlist disqus reply replies respond "
    "share sharing social related recommended recommendations widget pagination pager skip complementary contentinfo".split()
)
#: Marks of reader comments.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Marks that decide as the head of a name, whatever qualifies them.
STRONG = COMMENTS | frozenset("ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion nav navbar navigation breadcrumb breadcrumbs sidebar topbar cookie cookies consent gdpr newsletter subscribe subscription related recommended recommendations social".split())
#: Words that may follow or precede those marks in a name within the article; any other word makes it a name of content.
NEUTRAL = frozenset(
    "post posts article articles story stories link links list box block section container wrapper inner outer button buttons bar area item items row content form top bottom left right widget module panel icon icons count "
    "slot unit card cards cta thread tools tool media reading body text group holder holders site page paywall user users author inline sticky google reader readers".split()
)
#: Words before a mark that tell what a wrapper has, and words after one that make it a name of the wrapper.
STATES = frozenset("with without has have no not is hide show non".split())
WRAPPERS = frozenset("page layout root app site main document website wrap".split())
#: Words before "header" that make it the heading of the text.
HEADED = frozenset("article post entry story content news headline title section".split())
#: Marks outside the article that are ordinary names of blocks within it.
_WITHIN = MARKS - frozenset(("header", "alert", "alerts", "disclaimer", "search"))
CONTENT = frozenset(("article", "main"))
#: Blocks that hold running text, not other blocks of it.
_LEAVES = frozenset("p li td h1 h2 h3 h4 h5 h6 blockquote pre".split())
_CLOSES = frozenset("li tr td th dt dd option".split())
_LAST_CLOSE = re.compile(r"</([a-zA-Z][^\s/>]*)")
_ends: dict[str, re.Pattern] = {}
WINDOW = 3
THRESHOLD = 80


@dataclass
class Tree:
    """Block elements by number: tag, parent, last descendant, outermost article or main element around (0: none), and what its name marks it as."""

    tags: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [0])
    last: list[int] = field(default_factory=lambda: [0])
    content: list[int] = field(default_factory=lambda: [0])
    mark: list[int] = field(default_factory=lambda: [0])

    def add(self, tag: str, parent: int, mark: int) -> int:
        number = len(self.tags)
        self.tags.append(tag)
        self.parent.append(parent)
        self.last.append(number)
        self.content.append(self.content[parent] or (number if tag in CONTENT else 0))
        self.mark.append(mark)
        return number


@dataclass
class Line:
    """A block of text: the element that it lies in, its text, and how much of it is in links."""

    element: int
    text: str
    linked: int


def _parts(name: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]


#: What a name says of an element: nothing, boilerplate, or reader comments.
PLAIN, BOILER, COMMENT = 0, 1, 2


def name_mark(name: str, within: bool) -> int:
    """What a class, id or role name marks an element as; ``within`` the article, only by whole names or strong marks."""
    parts = _parts(name)
    parts += [a + b for a, b in zip(parts, parts[1:], strict=False) if a + b in MARKS]
    if not parts or MARKS.isdisjoint(parts) and STRONG.isdisjoint(parts):
        return PLAIN
    if not STATES.isdisjoint(parts) or parts[-1] in WRAPPERS and len(parts) > 1:
        return PLAIN
    head = next((w for w in reversed(parts) if w in MARKS or w in STRONG or w not in NEUTRAL and not w.isdigit()), "")
    if head in COMMENTS:
        return COMMENT
    if within:
        whole = not _WITHIN.isdisjoint(parts) and all(w in MARKS or w in NEUTRAL or w.isdigit() for w in parts)
        return BOILER if whole or head in STRONG else PLAIN
    if head == "header" and not HEADED.isdisjoint(parts):
        return PLAIN
    return BOILER


def _mark(attributes: str, within: bool) -> int:
    """What the class, id and role of an element mark it as."""
    if "=" not in attributes:
        return PLAIN
    return max((name_mark(name, within) for value in _ATTRIBUTE.findall(attributes) for name in value.strip("\"'").split()), default=PLAIN)


def page_lines(html: str) -> tuple[list[Line], Tree]:
    """The blocks outside boilerplate elements, and the tree of block elements with their marks."""
    last_close = {m.group(1).lower(): m.start() for m in _LAST_CLOSE.finditer(html)}
    limit = html.rfind(">") + 1  # no markup ends beyond it
    tree, lines = Tree(), []
    # The open elements: tag, whether it lies in boilerplate, and its block element; which of them are blocks; and how many have a tag.
    stack: list[tuple[str, bool, int]] = [("", False, 0)]
    blocks: list[int] = []
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked, element, at = 0, 0, 0

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            lines.append(Line(element, text, min(linked, len(text))))
        parts, linked = [], 0

    def close(index: int) -> None:
        nonlocal element
        block = bool(blocks) and blocks[-1] >= index
        if block:
            flush()
        while len(stack) > index:
            tag, _, number = stack.pop()
            opened[tag] -= 1
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
                tree.last[number] = len(tree.tags) - 1
        if block:
            element = stack[-1][2]

    while at < len(html):
        match = _TOKEN.search(html, at, limit) if at < limit else None
        text = html[at : match.start()] if match else html[at:].partition("<!--")[0]
        if text and not stack[-1][1]:
            text = unescape(text)
            parts.append(text)
            if opened.get("a"):
                linked += len(text.strip())
        if not match:
            break
        at = match.end()
        slash, tag, attributes = match.group(1, 2, 3) if match.group(2) else match.group(4, 5, 6)
        if not tag:
            if match.group().startswith("<!--") and not match.group().endswith(("-->", "--!>")):
                break  # a comment that is never closed
            continue
        tag = tag.lower()
        if slash:
            if opened.get(tag):
                index = len(stack) - 1
                while stack[index][0] != tag:
                    index -= 1
                close(index)
            elif tag not in INLINE:
                flush()
            continue
        if tag in RAW:
            if last_close.get(tag, -1) >= at:
                end = _ends.get(tag) or _ends.setdefault(tag, re.compile(rf"</{re.escape(tag)}(?![\w-])", re.I))
                found = end.search(html, at)
                at = html.find(">", found.start()) + 1 or len(html) if found else at
            elif tag in ("script", "style"):
                at = len(html)
            parts.append(" ")
            continue
        inline = tag in INLINE
        if tag in VOID:
            if not inline:
                flush()
            elif tag in ("br", "img"):
                parts.append(" ")
            continue
        if not inline:
            if blocks and (stack[blocks[-1]][0] == "p" or stack[blocks[-1]][0] == tag and tag in _CLOSES):
                close(blocks[-1])
            flush()
        _, inside, parent = stack[-1]
        content = tag in CONTENT or "=" in attributes and bool(_BODY.search(attributes))
        mark = PLAIN
        if not inside and tag not in ("html", "body"):
            within = tree.content[parent] > 0
            mark = _mark(attributes, within)
            if content:  # an article that is in no other is dropped for its name only if it is a comment
                mark = mark if mark == COMMENT or within else PLAIN
            elif tag == "form":
                mark = max(mark, BOILER)
            closed = last_close.get(tag, -1) >= at
            mark = mark if closed else PLAIN
            # A header inside the article holds its title.
            hard = not content and tag in BOILERPLATE and not (tag == "header" and within) or not content and bool(_HIDDEN.search(attributes))
            inside = closed and (hard or inline and mark != PLAIN)
        kind = "article" if content and mark != COMMENT else "div" if content else tag
        number = parent if inline else tree.add(kind, parent, mark)
        if not inline:
            blocks.append(len(stack))
            element = number
        stack.append((tag, inside, number))
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    close(1)
    tree.last[0] = len(tree.tags) - 1
    return lines, tree


def regions(lengths: list[int]) -> list[tuple[int, int]]:
    """First and last + 1 line of each region between a surge and its dive."""
    n, out, at = len(lengths), [], 0
    sums = [sum(lengths[i : i + WINDOW]) for i in range(n)]
    while at < n:
        if sums[at] < THRESHOLD:
            at += 1
            continue
        first = at
        while first < n and lengths[first] == 0:
            first += 1  # the window's text lies further on
        last = max(first, at)
        while last < n and sums[last] > 0:
            last += 1
        out.append((first, last))
        at = max(last, at + 1)
    return out


def core_region(lengths: list[int]) -> tuple[int, int] | None:
    """The region with the most text, the first of them."""
    return max(regions(lengths), key=lambda r: sum(lengths[r[0] : r[1]]), default=None)


def unmarked(lines: list[Line], tree: Tree) -> list[Line]:
    """The lines outside elements that their names mark, but for elements that the page needs."""
    if not any(tree.mark):
        return lines
    size = len(tree.tags)
    near = [0] * size  # the innermost marked element around
    for e in range(1, size):
        near[e] = e if tree.mark[e] else near[tree.parent[e]]
    own, article, plain = [0] * size, [0] * size, [0] * size
    for x in lines:
        n = len(x.text) - x.linked
        own[x.element] += n
        article[x.element] += n * (tree.content[x.element] > 0)
        plain[near[x.element]] += n
    total, articles = [0, *accumulate(own)], [0, *accumulate(article)]
    free = any(article[x.element] and not near[x.element] for x in lines)
    outside, dropped, e = plain[0], [False] * size, 1
    while e < size:
        if tree.mark[e]:
            text, held = (sums[tree.last[e] + 1] - sums[e] for sums in (total, articles))
            if tree.mark[e] == COMMENT:
                needed = not outside and text > 4 * THRESHOLD
            else:
                needed = held > outside or not free and text > 4 * max(outside, THRESHOLD)
            if needed:
                outside += plain[e]
                free = free or held > 0
            else:
                dropped[e : tree.last[e] + 1] = [True] * (tree.last[e] + 1 - e)
                e = tree.last[e]
        e += 1
    return [x for x in lines if not dropped[x.element]]


def main_text(html: str | None) -> str:
    """The main text of one page."""
    lines, tree = page_lines(html or "")
    lines = unmarked(lines, tree)
    if not lines:
        return ""
    lengths = [len(x.text) - x.linked for x in lines]
    first, last = core_region(lengths) or (0, len(lines))
    held = {x.element for x in lines[first:last] if len(x.text) > x.linked} or {x.element for x in lines[first:last]}
    content = {tree.content[e] for e in held}
    if 0 not in content:
        return "\n\n".join(x.text for x in lines if tree.content[x.element] in content)
    holder, high = min(held), max(held)
    while holder and (tree.last[holder] < high or tree.tags[holder] in _LEAVES):
        holder = tree.parent[holder]
    if holder and tree.tags[holder] not in ("html", "body"):
        return "\n\n".join(x.text for x in lines if holder <= x.element <= tree.last[holder])
    beside, content = {tree.parent[e] for e in held}, content - {0}
    taken = [r for r in regions(lengths) if any(lengths[i] and tree.parent[lines[i].element] in beside for i in range(*r))] or [(first, last)]
    keep = [tree.content[x.element] in content for x in lines]
    for a, b in taken:
        # Short blocks before a surge belong to it if they are its first block's neighbours in one parent.
        while a and tree.parent[lines[a - 1].element] == tree.parent[lines[a].element] and lengths[a - 1]:
            a -= 1
        keep[a:b] = [True] * (b - a)
    for i in range(taken[0][0], taken[-1][1]):
        keep[i] = keep[i] or lengths[i] > 0 and tree.parent[lines[i].element] in beside
    return "\n\n".join(x.text for x, k in zip(lines, keep, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars (code points) of each page."""
    rows = pages.select(id_col, url_col, F.col(html_col).cast("string").alias("__html"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:2]) + ", text string, n_chars long"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url_col, "text", "n_chars"])

    return map_arrow(rows, run, schema)
