"""Main text of web pages by a minimum cut between content and boilerplate."""

from __future__ import annotations

import re
from collections import deque
from html import unescape

from pyspark.sql import DataFrame

from trialweave.functions.ship import map_arrow
from trialweave.llm.common import small_batches

#: What an element's name may be, attributes with whole quotes, and the elements whose content is no text.
_NAME = re.compile(r"/?([a-z][^\s/>]*)", re.I)
_QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
_RAW = frozenset("script style template svg math title iframe noembed noframes noscript textarea select head".split())
_HINTS = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NUMBER = re.compile(r"&#(x?)0*([0-9a-f]+);?", re.I)

#: Elements that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the key closes an open element of these names.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
LISTS = frozenset("ul ol dl table".split())
SCOPES = frozenset("article aside blockquote body div footer form header main nav section table td th ul ol dl".split())

BAD_TAGS = frozenset("nav footer aside form button dialog menu fieldset object audio video canvas map".split())
GOOD_TAGS = frozenset("article main".split())
BAD_WORDS = frozenset("""ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentary
    cookie cookies consent copyright dialog discussion disqus dropdown footer form login masthead menu menus modal nav navbar navigation
    newsletter notice notices notification pagination pager popup promo promotion related reply replies respond search share sharing
    sidebar sidebars signup skip social sponsor sponsored subscribe tags toolbar topbar widget widgets alert complementary contentinfo
    feedback""".split())
GOOD_WORDS = frozenset("article content entry main post story maintext bodytext articlebody".split())
HEAD_WORDS = frozenset("header banner masthead".split())

#: Costs in thousandths.  A block's own evidence: a constant, each of its first ``MOST_WORDS`` words, a sentence's
#: end, its share of linked words, and its place.  Places are evidence among others: a short block in an article, a
#: block with links, and all blocks of pages that name no places are settled by their neighbours.
START, WORD, MOST_WORDS, SENTENCE, LINK, IN_ARTICLE, IN_BOILERPLATE = -900, 60, 30, 800, 1200, 900, 5000
#: Smoothness: between blocks that follow each other in the same kind of place or in different ones, and between a block
#: and the one before it in its parent.  A tie weakens by up to half as the blocks' shares of linked words differ.
ALIKE, NEXT, SAME_PARENT = 600, 20, 300


class Block:
    __slots__ = ("text", "words", "links", "bad", "good", "parent")

    def __init__(self, text, links, bad, good, parent):
        self.text, self.words, self.bad, self.good, self.parent = text, len(text.split()), bad, good, parent
        self.links = min(links, self.words)


def tokens(page: str):
    """(start, end, name, closes, attributes) of a page's tags and comments in order; the latter have the name ``""`` or, with raw content, ``!``.

    Every character is looked at a bounded number of times.  A comment or raw element that
    does not end takes the rest of the page.  Quotes that do not end stop counting as such
    from there on, and a ``<`` with no ``>`` after it is text.
    """
    last = page.rfind(">")
    ends: dict[str, re.Pattern] = {}
    quotes, at = True, page.find("<")
    while at >= 0 and (at < last or page.startswith("<!--", at)):
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", False, ""
        elif m := _NAME.match(page, at + 1):
            name, closes, start = m.group(1).lower(), page[at + 1] == "/", m.end()
            end = _QUOTED.match(page, start).end() if quotes else page.find(">", start)
            if page[end:end + 1] != ">":
                quotes = False
                end = page.find(">", start)
            attributes, end = page[start:end], end + 1
            if name in _RAW and not closes:
                if name not in ends:
                    ends[name] = re.compile(rf"</{name}\s*>", re.I)
                found = ends[name].search(page, end)
                yield at, found.end() if found else len(page), "!", False, ""
                end = found.end() if found else len(page)
            else:
                yield at, end, name, closes, attributes
        elif page[at + 1] in "!?/":
            end = page.find(">", at) + 1
            yield at, end, "", False, ""
        else:
            end = at + 1
        at = page.find("<", end)


def decoded(text: str) -> str:
    """``text`` without character references; numbers beyond Unicode give U+FFFD."""
    if "&" not in text:
        return text
    return unescape(_NUMBER.sub(lambda m: f"&#{m[1]}{m[2]};" if len(m[2]) < 8 else "\ufffd", text) if "&#" in text else text)


def _hints(attributes: str) -> tuple[bool, bool, bool]:
    """Whether class, id and role speak of boilerplate, of content, of a page header."""
    bad = good = head = False
    for name, value in _HINTS.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("hidden", "aria-hidden"):
            bad |= name == "hidden" or value == "true"
        elif name == "style":
            bad |= "display:none" in value.replace(" ", "")
        else:
            words = set(re.split(r"[^a-z]+", value))
            head |= bool(words & HEAD_WORDS)
            bad |= bool(words & BAD_WORDS)
            good |= bool(words & GOOD_WORDS)
    return bad, good, head


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, with their place in the document."""
    out: list[Block] = []
    # Open elements: name, bad, good, number, and the places of the nearest scope and the nearest list or table.
    stack: list[tuple[str, bool, bool, int, int, int]] = [("", False, False, 0, 0, 0)]
    places: dict[str, list[int]] = {}
    text: list[str] = []
    made = linked = links = 0

    def flush() -> None:
        nonlocal links
        if text:
            if words := " ".join(decoded("".join(text)).split()):
                top = stack[-1]
                _, bad, good, parent, _, _ = stack[top[4]]
                out.append(Block(words, links, bad or top[1], good or top[2], parent))
            text.clear()
        links = 0

    def close(names, limit=0) -> None:
        """Close the nearest open element of ``names`` and all in it, unless it lies outside the element at ``limit``."""
        nonlocal linked
        k = max((places[n][-1] for n in names if places.get(n)), default=0)
        if 0 < k >= limit:
            for name, *_ in stack[k:]:
                linked -= name == "a"
                places[name].pop()
            del stack[k:]

    at = 0
    for start, end, name, closes, attributes in tokens(page):
        if start > at:
            run = page[at:start]
            text.append(run)
            if linked:
                links += len(run.split())
        at = end
        if not name or name == "!":
            if name:
                flush()
            continue
        if name not in INLINE:
            flush()
        if closes:
            close((name,), 0 if name in SCOPES else stack[-1][4])
            continue
        if name in CLOSES_P:
            close(("p",), stack[-1][4])
        elif name in CLOSES:
            close(CLOSES[name], stack[-1][5])
        if name in VOID:
            continue
        _, bad, good, _, scope, listed = stack[-1]
        head = name == "header"
        if attributes.strip():
            b, g, h = _hints(attributes)
            head |= h and not g
            if name not in ("body", "html"):
                bad |= b and not (g and good) and not (h and good)
                good |= g
        if name in BAD_TAGS or head and not good:
            bad = True
        elif name in GOOD_TAGS:
            good = True
        made += 1
        linked += name == "a"
        place = len(stack)
        places.setdefault(name, []).append(place)
        stack.append((name, bad, good, made, place if name in SCOPES else scope, place if name in LISTS else listed))
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


def leaning(block: Block) -> int:
    """Evidence for content over boilerplate: the difference of the two terminal capacities."""
    score = START + WORD * min(block.words, MOST_WORDS) - LINK * block.links // block.words
    if block.text[-1] in ".!?…\"”»":
        score += SENTENCE
    return score + IN_ARTICLE * block.good - IN_BOILERPLATE * block.bad


def edges(found: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness: between neighbours, and between a block and the one before it in its parent."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        for j, alike, other in ((i - 1, ALIKE, NEXT), (last.get(b.parent, -1), SAME_PARENT, 0)):
            if j >= 0:
                x = found[j]
                apart = abs(x.links * b.words - b.links * x.words)
                weight = alike if (x.good, x.bad) == (b.good, b.bad) else other
                out.append((j, i, weight - weight * apart // (2 * x.words * b.words)))
        last[b.parent] = i
    return out


def minimum_cut(lean: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut; of several, the least such side.

    ``lean`` > 0 is the node's capacity from the source, < 0 the one to the sink, after
    both terminals' common part is taken off; ``links`` are edges of equal capacity both
    ways.  A node of at most two neighbours is taken out: the least cost of its two sides,
    for each of theirs, becomes capacities of theirs and of an edge between them.  A page's
    edges are nested, as its elements are, so this takes out all its nodes, in linear time;
    what other graphs leave is cut by :func:`flow`.  Sides are then given back in reverse.
    """
    gain = list(lean)
    cap: list[dict[int, int]] = [{} for _ in lean]  # cap[a][b]: what a on the source's side costs, b not
    for a, b, c in links:
        if a != b:
            cap[a][b] = cap[a].get(b, 0) + c
            cap[b][a] = cap[b].get(a, 0) + c
    gone = [False] * len(gain)
    order: list[tuple[int, int, list[tuple[int, int, int]]]] = []
    queue = [i for i, x in enumerate(cap) if len(x) <= 2]
    while queue:
        v = queue.pop()
        if gone[v] or len(cap[v]) > 2:
            continue
        gone[v] = True
        near = [(u, out, cap[u].pop(v)) for u, out in cap[v].items()]
        order.append((v, gain[v], near))
        if len(near) == 2:
            (a, va, av), (b, vb, bv) = near
            f00, f10 = min(0, va + vb - gain[v]), min(av, vb - gain[v])
            f01, f11 = min(bv, va - gain[v]), min(av + bv, -gain[v])
            gain[a] -= f10 - f00
            gain[b] -= f11 - f10
            cap[b][a] = cap[b].get(a, 0) + f01 + f10 - f00 - f11
            cap[a].setdefault(b, 0)
        elif near:
            (a, va, av), = near
            gain[a] -= min(av, -gain[v]) - min(0, va - gain[v])
        queue += [u for u, _, _ in near if len(cap[u]) <= 2]
    left = [i for i, g in enumerate(gone) if not g]
    side = [False] * len(gain)
    if left:
        at = {i: k for k, i in enumerate(left)}
        for i, s in zip(left, flow([gain[i] for i in left], [{at[j]: c for j, c in cap[i].items()} for i in left])):
            side[i] = s
    for v, g, near in reversed(order):
        side[v] = sum(out for u, out, _ in near if not side[u]) - g < sum(into for u, _, into in near if side[u])
    return side


def flow(supply: list[int], rest: list[dict[int, int]]) -> list[bool]:
    """What the source still reaches after a maximum flow by shortest augmenting paths."""
    while True:
        came = {i: -1 for i, s in enumerate(supply) if s > 0}
        queue = deque(came)
        end = -1
        while queue:
            i = queue.popleft()
            if supply[i] < 0:
                end = i
                break
            for j, c in rest[i].items():
                if c > 0 and j not in came:
                    came[j] = i
                    queue.append(j)
        if end < 0:
            return [i in came for i in range(len(supply))]
        path = [end]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        most = min(-supply[end], supply[path[-1]], *(rest[j][i] for i, j in zip(path, path[1:])))
        supply[path[-1]] -= most
        supply[end] += most
        for i, j in zip(path, path[1:]):
            rest[j][i] -= most
            rest[i][j] += most


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    chosen = minimum_cut([leaning(b) for b in found], edges(found))
    return " ".join(b.text for b, keep in zip(found, chosen) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: ``id_col``, ``url_col``, ``text``, ``n_chars`` (code points).

    The whole page is cut into blocks at block-level tags; scripts, styles, comments in the
    markup and the head have no block.  Each block's words, links, sentence ends and place
    (article, menu, advert, reader comments, ...) give its terminal capacities, and edges
    tie it to its neighbours and to the previous block of the same parent.  The blocks on
    the content side of the minimum cut are joined by a space; character references are
    decoded and white space inside a block becomes one space.  Time is linear in the page.

    A null or empty page, or one without content, has an empty text.  Broken markup is read
    leniently: unclosed elements end with the page.  Rows never meet, so repeated rows and
    null ids have no effect; other columns are not read.  An empty table gives an empty result.
    """
    chosen = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    kinds = [chosen.schema[c].dataType.simpleString() for c in ("id", "url")]

    def run(batches):
        import pyarrow as pa

        for batch in small_batches(batches, 2):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["id", "url", "text", "n_chars"])

    out = map_arrow(chosen, run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
