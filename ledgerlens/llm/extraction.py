"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks at block-level tags. A fixed linear classifier on tag, class and id names of a block and
its ancestors, link density and text form gives each block the cost of calling it boilerplate and the cost of
calling it content; these are its capacities to the two terminals. Blocks next to each other, and blocks in the same
container, are joined by smoothness capacities that fall with their distance in the tree. The minimum cut labels
all blocks of a page at once. Each page is labelled by itself within a map over Arrow batches; nothing is shuffled.

Character references are decoded, white space inside a block becomes one space, and the blocks called content are
joined by one line feed in page order. Where a page has an article, or an element named as a container of content,
blocks outside it start with worse odds. Null, empty and tagless pages are handled alike: text outside all tags is a
block of its own. Repeated rows give repeated results.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

# Element names of HTML by role.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TAGS = frozenset("head title script style noscript template iframe object svg button select textarea option canvas".split())
BOILERPLATE_TAGS = frozenset("nav aside footer form menu dialog".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising announcement banner breadcrumb breadcrumbs comment comments"
    " complementary consent contentinfo cookie cookies copyright disclaimer discussion disqus footer gdpr header login masthead"
    " menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo"
    " promoted promotion recommended related replies reply respond search searchform share sharing sidebar sidebars sidenav"
    " signup social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
# Names that make even an element for articles something else.
OTHER_ARTICLES = frozenset("ad ads advert advertisement comment comments promo promoted recommended related reply replies sponsored".split())
CONTENT_TAGS = frozenset(["article", "main"])
CONTENT_NAMES = frozenset("article articlebody content entry main post story text body".split())
# The same roles in names written as one word, such as pagefooter or maincontent.
BOILERPLATE_COMPOUND = re.compile(
    "sidebar|footer|navbar|navigation|navlink|comment(?!ar)|cookie|advert|sponsor|newsletter|breadcrumb|masthead|disqus|popup|subscri"
    "|^(?:google)?ads?(?:bar|block|box|container|frame|slot|space|spot|unit|wrap|wrapper|zone)s?$"
    "|^(?:bottom|foot|head|left|main|page|right|side|site|sub|top|user)(?:bar|header|links|menu|nav)s?$"
)
CONTENT_COMPOUND = re.compile("^(?:article|body|entry|main|news|page|post|story)(?:body|content|text)$")
#: Log odds that an element's names give to all blocks in it.
BOILERPLATE_HINT, CONTENT_HINT, ARTICLE_HINT = -6.0, 3.0, 4.5
#: The same in what holds other articles (comments, teasers, adverts); within any other boilerplate an article starts anew.
OTHERS_HINT = -6.5
OTHERS_TAGS = frozenset("nav aside footer menu dialog".split())
#: Elements whose ids, within an article, are made from its headings (but for a section of comments).
HEADED_TAGS = frozenset("h1 h2 h3 h4 h5 h6 section".split())
#: Log odds of blocks outside all articles of a page that has one; of one that names only a container of content.
OUTSIDE_HINT, ASIDE_HINT = -4.5, -2.5

_OPENING = re.compile(r"<!--|<(/?)([a-zA-Z][a-zA-Z0-9]*)|<[!?]")
_REST_OF_TAG = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
# Elements whose content isn't mark-up.
RAW_TAGS = frozenset("script style textarea title noscript template iframe".split())
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW_TAGS}
_IDS = re.compile(r"""(?<![\w-])id\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_ABOUT_OTHERS = re.compile(r"(?<!\S)(?:no|has|with|without)[-_]\S+", re.I)
_WORD_START = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


class _Open:
    __slots__ = ("tag", "hint", "skip", "number", "depth", "parent", "place", "block")

    def __init__(self, tag, hint, skip, number, parent, place=0):
        self.tag, self.hint, self.skip, self.number, self.parent, self.place = tag, hint, skip, number, parent, place
        self.depth = parent.depth + 1 if parent else 0
        self.block = self if parent is None or tag in BLOCK_TAGS else parent.block  # the innermost block with this element


def _names(attributes: str) -> set[str]:
    """Words of class, id, role and itemprop. Class names such as has-sidebar tell what is elsewhere and are left out."""
    names: set[str] = set()
    for value in _NAMES.findall(attributes):
        plain = _WORD_START.sub("-", _ABOUT_OTHERS.sub(" ", value.strip("\"'")))
        names.update(re.split(r"[^a-z0-9]+", plain.lower()))
    return names


def _hint(tag: str, attributes: str, above: float) -> float:
    """What an element says of its content: above 0 for content; the last say of boilerplate holds below it."""
    if above < -1 and tag != "main" and (tag != "article" or above <= OTHERS_HINT):  # names of a layout tell nothing of these
        return above
    if above >= ARTICLE_HINT and tag in HEADED_TAGS:
        attributes = _IDS.sub(lambda m: m[0] if tag == "section" and m[1].strip("\"'").lower() in ("comment", "comments") else " ", attributes)
    names = _names(attributes) if attributes else set()
    if tag in ("html", "body", "main"):  # their names are about the layout of the page
        boilerplate = False
    elif tag == "article":
        boilerplate = bool(names & OTHER_ARTICLES)
    else:
        said = {n for n in names if n in BOILERPLATE_NAMES or BOILERPLATE_COMPOUND.search(n)}
        if above > 0:  # an article's own header is part of it
            said.discard("header")
        boilerplate = bool(said) or tag in BOILERPLATE_TAGS or tag == "header" and above <= 0
    if boilerplate:
        return OTHERS_HINT if tag in OTHERS_TAGS or names & OTHER_ARTICLES else BOILERPLATE_HINT
    if tag == "article":
        return ARTICLE_HINT
    if tag in CONTENT_TAGS or tag not in ("html", "body") and any(n in CONTENT_NAMES or CONTENT_COMPOUND.match(n) for n in names):
        return max(CONTENT_HINT, above)
    return above


def tags_of(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of every tag, in time linear in the page; comments have no name.

    The raw content of scripts and the like belongs to their tag, and what is never closed goes on to the end. Where a
    tag doesn't end because its quotes aren't closed, quotes stop to count for the rest of the page.
    """
    at, quotes, last = 0, True, page.rfind(">")
    while m := _OPENING.search(page, at):
        start, tag = m.start(), (m[2] or "").lower()
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            at = end + 3 if end >= 0 else len(page)
            yield start, at, False, "", ""
            continue
        if start > last:  # no tag can end any more
            return
        attributes = ""
        rest = _REST_OF_TAG.match(page, m.end()) if quotes and tag else None
        if rest:
            attributes, at = rest[1], rest.end()
        else:
            quotes = quotes and not tag
            at = page.find(">", m.end()) + 1
            attributes = page[m.end() : at - 1] if tag else ""
        if tag in RAW_TAGS and not m[1]:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            tag = ""
        yield start, at, bool(m[1]), tag, attributes


def blocks_of(page: str) -> list[dict]:
    """Blocks in page order: text, hint, tag, letters in links, and the open element that holds it."""
    blocks: list[dict] = []
    root = _Open("", 0.0, False, 0, None)
    stack, held, linked, count = [root], [], 0, 0
    is_open: Counter = Counter()

    def close_block():
        nonlocal held, linked
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
        if text:
            holder = stack[-1].block
            blocks.append({"text": text, "hint": stack[-1].hint, "tag": holder.tag, "linked": linked, "at": holder})
        held, linked = [], 0

    def take(text):
        nonlocal linked
        if not stack[-1].skip:
            held.append(text)
            if any(o.tag == "a" for o in stack[-3:]):
                linked += len(text)

    def close_from(place):
        for o in stack[place:]:
            is_open[o.tag] -= 1
        del stack[place:]

    at = 0
    for start, end, closing, tag, attributes in tags_of(page):
        if start > at:
            take(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "br":
            take(" ")
            continue
        block = tag in BLOCK_TAGS
        if block:
            close_block()
        if closing:
            if is_open[tag]:
                place = len(stack) - 1
                while stack[place].tag != tag:
                    place -= 1
                close_from(place)
            continue
        if tag in VOID_TAGS:
            continue
        if block:
            inner = stack[-1].block  # a block ends an open paragraph, an item the item before it
            if inner.tag == "p" or tag == "li" and inner.tag == "li":
                close_from(inner.place)
        if not attributes.endswith("/") or block:
            count += 1
            top = stack[-1]
            if tag == "body":
                top = root
            skip = (top.skip or tag in SKIPPED_TAGS) and tag != "body"
            stack.append(_Open(tag, _hint(tag, attributes, top.hint), skip, count, stack[-1], len(stack)))
            is_open[tag] += 1
    if at < len(page):
        take(page[at:])
    close_block()
    return blocks


def content_odds(block: dict) -> float:
    """Log odds that a block is content."""
    text = block["text"]
    words = text.count(" ") + 1
    odds = block["hint"] + 0.6 * min(math.log2(words), 6.0) - 1.6
    odds += 0.6 if text[-1] in ".!?:;…\"'”»" else 0.0
    odds += {"p": 0.8, "h1": 1.2, "h2": 0.6, "h3": 0.4, "li": -0.6, "pre": 0.8, "blockquote": 0.8}.get(block["tag"], 0.0)
    links = 1.5 if block["hint"] >= ARTICLE_HINT else 3.0  # links within an article tell less
    return odds - links * min(1.0, block["linked"] / max(1, len(text)))


def tree_distance(a: _Open, b: _Open) -> int:
    steps = 0
    while a is not b:
        if a.depth < b.depth:
            a, b = b, a
        a = a.parent
        steps += 1
    return steps


def smoothness(blocks: list[dict]) -> list[tuple[int, int, int]]:
    """(i, j, capacity): neighbours in the page, and each block with the one before it in its container."""
    edges, last = [], {}
    for j, b in enumerate(blocks):
        if j:
            edges.append((j - 1, j, round(600 / (1 + tree_distance(blocks[j - 1]["at"], b["at"])))))
        container = b["at"].parent or b["at"]
        i = last.get(container.number)
        if i is not None:
            edges.append((i, j, 300))
        last[container.number] = j
    return edges


def min_cut(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Source side of a minimum cut; ``gain`` is a node's capacity from the source less that to the sink.

    Nodes whose own terminal outweighs all their edges are decided at once, and so on for what they leave over;
    augmenting paths (breadth first) solve the rest. Of equally good cuts it is the one with the smallest source side.
    """
    n = len(gain)
    gain = list(gain)
    around: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, c in edges:
        if i != j and c > 0:
            around[i][j] = around[i].get(j, 0) + c
            around[j][i] = around[j].get(i, 0) + c
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is not None:
            continue
        if (reach := sum(around[i].values())) < gain[i] or -gain[i] >= reach:
            side[i] = gain[i] > 0 and gain[i] > reach
            for j, c in around[i].items():
                gain[j] += c if side[i] else -c
                del around[j][i]
                todo.append(j)
            around[i] = {}
    for i in range(n):
        if side[i] is None:
            _cut_component(i, gain, around, side)
    return [bool(s) for s in side]


def _cut_component(start: int, gain: list[int], around: list[dict[int, int]], side: list[bool | None]) -> None:
    """Decides the nodes that hang together with ``start``, by augmenting paths."""
    rest, queue = {start: None}, deque([start])
    while queue:
        for j in around[queue.popleft()]:
            if j not in rest:
                rest[j] = None
                queue.append(j)
    left = {i: max(gain[i], 0) for i in rest}  # from the source
    sink = {i: max(-gain[i], 0) for i in rest}
    while True:
        came: dict[int, int | None] = {i: None for i in rest if left[i] > 0}
        queue, end = deque(came), None
        while queue and end is None:
            i = queue.popleft()
            if sink[i] > 0:
                end = i
                break
            for j, c in around[i].items():
                if c > 0 and j not in came:
                    came[j] = i
                    queue.append(j)
        if end is None:
            for i in rest:
                side[i] = i in came
            return
        path = [end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        flow = min(left[path[-1]], sink[end], *(around[b][a] for a, b in zip(path, path[1:], strict=False)))
        left[path[-1]] -= flow
        sink[end] -= flow
        for a, b in zip(path, path[1:], strict=False):
            around[b][a] -= flow
            around[a][b] = around[a].get(b, 0) + flow


def main_text(page: bytes | None) -> str:
    blocks = blocks_of(page.decode("utf-8", "replace")) if page else []
    if not blocks:
        return ""
    gain, best = [], max(b["hint"] for b in blocks)
    for b in blocks:
        odds = content_odds(b)
        if b["hint"] == 0 and (best >= ARTICLE_HINT or best > 0 and b["tag"] != "h1"):  # a title can stand before the container
            odds += OUTSIDE_HINT if best >= ARTICLE_HINT else ASIDE_HINT
        # cost of calling it boilerplate: -log(1 - p); content: -log p
        gain.append(round(1000 * (math.log1p(math.exp(odds)) - math.log1p(math.exp(-odds)))))
    keep = min_cut(gain, smoothness(blocks))
    return "\n".join(b["text"] for b, k in zip(blocks, keep, strict=True) if k)


OUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame, keep=("page_id", "url")) -> DataFrame:
    """Columns ``keep`` of ``pages`` with text and n_chars, its code points."""

    def fn(texts):
        made = [main_text(t) for t in texts]
        return [made, [len(t) for t in made]]

    return map_texts(pages, "html", fn, OUT, keep)
