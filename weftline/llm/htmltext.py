"""Main-text extraction from HTML by tag-path ratios.

A page is read once into blocks, each with its root-to-leaf path of block elements (tag, with
role words of class and id).  For every path the page's text length, punctuation, link text
and number of blocks are summed.  Paths pass what they have to their prefixes, so a heading
shares in the weight of the container around it.  Then, per path:

* ratio: characters outside links per block, times one plus the punctuation per block;
* smoothed: the mean of the ratios of neighbouring blocks in page order (radius 2);
* fused: the lesser of the path's own and the smoothed ratio, times the share of text
  that is not in links, times ``ROLE_WEIGHT`` if a role word of it or above it names a menu,
  header, footer, sidebar, notice, advert, form or comment.

The container is the deepest prefix that holds most of the fused weight, to which blocks in an
article or main element add by half as a prior.  Within it a path is content if its fused
value reaches ``threshold`` of the mean, with or without an article.  Beside such paths, in the
same parent, headings and short text elements (``FLOW``) without role words are admitted unless
half of their text is in links.  Elements that by their tag are no content, and hidden ones,
never are.

A link holds all blocks within it, up to its end or that of the element around it; inline elements that
are hidden or whose class or id names an advert are left out.  Time is linear in the length of a page.

Defined cases: null or empty html gives empty text; markup that ends early or nests wrongly is
read as far as it goes; repeated rows and null ids are rows like any other.  The page is read
whole, whatever its length.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm._spark import arrow_batches

#: Fixed word lists.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FLOW = HEADINGS | frozenset("p li dt dd th td pre blockquote caption figcaption".split())
LISTS = frozenset("ul ol dl table thead tbody tfoot tr figure".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form head menu dialog button select fieldset".split())
BOILERPLATE_ROLES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead topbar footer bottom sidebar side aside complementary contentinfo widget related recommended recommendations share sharing social "
    "comment comments disqus reply replies respond discussion notice notices cookie cookies consent gdpr popup modal overlay alert subscribe subscription newsletter "
    "signup login search form pagination pager copyright legal disclaimer hidden skip".split()
)
#: Role words of inline elements whose text is left out.
AD_ROLES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo".split())
#: What a role word leaves of the fused value.
ROLE_WEIGHT = 0.25
#: What an article or main element adds to the weight of its blocks, and the share of all weight that a container holds.
ARTICLE_WEIGHT, CONTAINER_SHARE = 1.5, 0.6
CLOSED_BY_BLOCK = frozenset("p".split())
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
PUNCTUATION = frozenset(",.;:!?…、。，！？،؟।¿¡")

TAG = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
SPECIAL = re.compile(r"""[>"']""")
ROLE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)


class Block:
    __slots__ = ("path", "parts", "linked", "bad", "role")

    def __init__(self, path, bad, role):
        self.path, self.parts, self.linked, self.bad, self.role = path, [], 0, bad, role


class Paths:
    """The paths of a page, each a number above that of the path it extends; 0 is the empty one.

    flow: the path above, without the lists and tables between.
    """

    def __init__(self):
        self.known: dict[tuple[int, str], int] = {}
        self.parent, self.tag, self.depth, self.article, self.flow = [0], [""], [0], [False], [0]

    def below(self, path: int, tag: str, label: str) -> int:
        own = self.known.setdefault((path, label), len(self.parent))
        if own == len(self.parent):
            self.parent.append(path)
            self.tag.append(tag)
            self.depth.append(self.depth[path] + 1)
            self.article.append(self.article[path] or tag in ("article", "main"))
            self.flow.append(self.flow[path] if self.tag[path] in LISTS else path)
        return own


class _Ends:
    """Where tags end, by quotes, in time that is linear in the page: no quote is tried twice in vain."""

    def __init__(self, page: str):
        self.page, self.near, self.vain = page, -1, set()

    def find(self, at: int) -> int:
        """Behind the ``>`` that ends a tag whose name ends here; -1 if none does."""
        page = self.page
        if self.near < at:
            m = SPECIAL.search(page, at)
            self.near = m.start() if m else len(page)
        p, tried = self.near, []
        while p < len(page) and p not in self.vain:
            if page[p] == ">":
                return p + 1
            tried.append(p)
            close = page.find(page[p], p + 1)
            if close < 0:
                break
            m = SPECIAL.search(page, close + 1)
            p = m.start() if m else len(page)
        self.vain.update(tried)
        return -1


def _labels(attributes: str) -> frozenset:
    words: set = set()
    for m in ROLE.finditer(attributes):
        words.update(SPLIT.split((m[1] or m[2] or m[3] or "").lower()))
    words.discard("")
    return frozenset(words)


class _Open:
    """The open block elements: (tag, path, boilerplate at or above it, role word at or above it), and where each tag stands."""

    def __init__(self):
        self.stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        self.places: dict[str, list[int]] = defaultdict(list)

    def push(self, tag: str, path: int, bad: bool, role: bool) -> None:
        self.places[tag].append(len(self.stack))
        self.stack.append((tag, path, bad, role))

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            self.places[self.stack.pop()[0]].pop()

    def last(self, tags) -> int:
        """The innermost open element of one of these tags; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, tag: str) -> None:
        if at := self.last((tag,)):
            self.cut(at)

    def implied(self, tag: str) -> None:
        """Closes what the beginning of a tag ends."""
        while self.stack[-1][0] in CLOSED_BY_BLOCK:
            self.cut(len(self.stack) - 1)
        if tag in HEADINGS and self.stack[-1][0] in HEADINGS:
            self.cut(len(self.stack) - 1)
        if tag in SIBLINGS:
            at = self.last({"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,)))
            if at > self.last((*SIBLINGS[tag], "table")):
                self.cut(at)


def read_blocks(page: str) -> tuple[list[Block], Paths]:
    """Blocks with text, in page order, and their paths."""
    blocks: list[Block] = []
    paths, opened, ends = Paths(), _Open(), _Ends(page)
    stack = opened.stack
    link = mute = 0  # the number of elements around an open link, or around an inline advert
    muted, nested = "", 0
    at, fresh = 0, True

    def text(raw: str) -> None:
        nonlocal fresh
        if not raw or mute:
            return
        if fresh:
            if not raw.strip():
                return
            blocks.append(Block(*stack[-1][1:]))
            fresh = False
        value = html.unescape(raw) if "&" in raw else raw
        blocks[-1].parts.append(value)
        if link:
            blocks[-1].linked += len(value)

    done = 0
    while m := TAG.search(page, at):
        start, at = m.start(), m.end()
        if m[2] is None:
            end = page.find("-->", at) if m[0] == "<!--" else page.find(">", at)
            if end < 0 and m[0] != "<!--":
                break
            text(page[done:start])
            at = done = len(page) if end < 0 else end + (3 if m[0] == "<!--" else 1)
            continue
        end = ends.find(at)
        if end < 0:
            continue  # no tag ends here: text
        text(page[done:start])
        tag, closing, attributes = m[2].lower(), bool(m[1]), page[at : end - 1]
        at = done = end
        if tag in INLINE:
            if tag == "a":
                link = len(stack) if not closing and "href" in attributes.lower() else 0
            if mute:
                nested += (-1 if closing else 1) * (tag == muted)
                mute = mute if nested else 0
            elif attributes and not closing and (HIDDEN.search(attributes) or _labels(attributes) & AD_ROLES):
                mute, muted, nested = len(stack), tag, 1
            continue
        if tag == "br":
            text(" " if not fresh else "")
            continue
        if tag in RAW and not closing:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
                end = page.find(">", end.end()) if end else -1
                at = done = len(page) if end < 0 else end + 1
            continue
        fresh = True
        if tag in VOID:
            continue
        if closing:
            opened.close(tag)
        else:
            opened.implied(tag)
        link, mute = (x if x <= len(stack) else 0 for x in (link, mute))  # they end with the element around them
        if closing:
            continue
        words = _labels(attributes) if attributes else frozenset()
        _, path, bad, role = stack[-1]
        bad = bad or tag in BOILERPLATE_TAGS or bool(attributes and HIDDEN.search(attributes))
        bad = bad or (tag == "header" and not opened.last(("article", "main")))
        role = role or (tag not in ("html", "body", "article", "main") and bool(words & BOILERPLATE_ROLES))
        opened.push(tag, paths.below(path, tag, tag + "".join("." + w for w in sorted(words))), bad, role)
        if attributes.endswith("/") and tag not in ("p", "div"):
            opened.cut(len(stack) - 1)
    text(page[done:])
    return blocks, paths


def _fused(blocks: list[Block], texts: list[str]) -> list[float]:
    chars: dict = defaultdict(int)
    marks: dict = defaultdict(int)
    linked: dict = defaultdict(int)
    count: dict = defaultdict(int)
    for b, t in zip(blocks, texts, strict=True):
        chars[b.path] += len(t)
        marks[b.path] += sum(c in PUNCTUATION for c in t)
        linked[b.path] += min(b.linked, len(t))
        count[b.path] += 1
    role = {b.path: ROLE_WEIGHT if b.role else 1.0 for b in blocks}
    ratio = {p: (chars[p] - linked[p]) / count[p] * (1 + marks[p] / count[p]) for p in count}
    out = []
    for i, b in enumerate(blocks):
        near = [0.0 if x.bad else ratio[x.path] for x in blocks[max(0, i - 2) : i + 3]]
        out.append(min(ratio[b.path], sum(near) / len(near)) * (1 - linked[b.path] / max(1, chars[b.path])) * role[b.path])
    return out


def _container(blocks: list[Block], fused: list[float], paths: Paths) -> int:
    """The path that stands for the article: the deepest with most of the weight below it."""
    n = len(paths.parent)
    weight, inner, total = [0.0] * n, [False] * n, 0.0
    below = [0.0] * n
    for b, f in zip(blocks, fused, strict=True):
        if not b.bad:
            f *= ARTICLE_WEIGHT if paths.article[b.path] else 1.0
            total += f
            weight[b.path] += f
            if b.path:
                inner[paths.parent[b.path]] = True
    for p in range(n - 1, 0, -1):
        below[paths.parent[p]] += weight[p] + below[p]
        inner[paths.parent[p]] |= inner[p]
    least = CONTAINER_SHARE * total * (1 - 1e-12)
    return max((p for p in range(n) if inner[p] and below[p] >= least), key=lambda p: (paths.depth[p], -p), default=0)


def _beside(block: Block, text: str, paths: Paths) -> bool:
    return not block.role and paths.tag[block.path] in FLOW and 2 * block.linked < len(text)


def extract(page: str | None, threshold: float = 0.2) -> str:
    """The main text: content blocks in page order, joined by newlines."""
    blocks, paths = read_blocks(page or "")
    texts = [" ".join("".join(b.parts).split()) for b in blocks]
    held = [i for i, t in enumerate(texts) if t]
    blocks, texts = [blocks[i] for i in held], [texts[i] for i in held]
    if not blocks:
        return ""
    fused = _fused(blocks, texts)
    root = _container(blocks, fused, paths)
    inside = [False] * len(paths.parent)
    for p in range(root, len(inside)):
        inside[p] = p == root or (p > 0 and inside[paths.parent[p]])
    own = [i for i, b in enumerate(blocks) if not b.bad and inside[b.path]]
    if not own:
        return ""
    least = threshold * sum(fused[i] for i in own) / len(own)
    best = {blocks[i].path for i in own if fused[i] >= least}
    flow = {paths.flow[p] for p in best}
    keep = [i for i in own if blocks[i].path in best or (_beside(blocks[i], texts[i], paths) and paths.flow[blocks[i].path] in flow)]
    return "\n".join(texts[i] for i in keep)


def _run(threshold: float):
    def run(batches):
        for batch in batches:
            texts = [extract(h, threshold) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, threshold: float = 0.2) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    arrow_batches(pages.sparkSession)
    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(_run(threshold), "page_id long, url string, text string, n_chars long")
