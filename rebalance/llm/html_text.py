"""Main text of web pages by minimum-cut labelling.

A page becomes a list of text blocks with their place in the tree of block elements. A
linear classifier gives each block a cost for being content or boilerplate (terminal
capacities). Smoothness edges join blocks that follow each other, the more so the
nearer they are in the tree, and blocks that follow each other under one parent with
other elements between. The minimum cut of that graph parts content from
boilerplate. Blocks whose own cost outweighs all their edges are settled first, which no
minimum cut contradicts; max-flow, in phases of shortest paths, decides the rest.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from rebalance.llm.common import row_slices

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|math|iframe|object|textarea|select|title)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-z][^>]*+(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong"
    " sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog button head fieldset".split())
BOILERPLATE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|banners?|breadcrumbs?|captcha|comments?|cookies?|copyright|disclaimer|"
    r"disqus|footer|form|header|login|masthead|menus?|modal|nav|navbar|navigation|newsletter|notices?|pager|pagination|popups?|"
    r"promos?|promotions?|recommended|related|replies|respond|search|share|sharing|sidebars?|signup|social|sponsors?|sponsored|"
    r"subscribe|subscription|toolbar|widgets?|complementary|contentinfo|alert)(?=$|[\s_0-9-])",
    re.I,
)
CONTENT_NAMES = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text)(?=$|[\s_0-9-])", re.I)
#: Weights of the classifier; positive speaks for content.
WEIGHTS = {
    "boilerplate": -12.0, "article": 5.0, "named": 3.0, "p": 1.0, "heading": 0.5, "item": -0.5,
    "words": 0.45, "links": -4.0, "stop": 0.5, "rights": -2.0, "outside": -3.0, "bias": 0.6,
}
NEXT = 0.5  # smoothness of blocks that follow each other
TREE = 1.4  # and what neighbours in the tree add; half of it for each further step between them
APART = 0.7  # blocks that follow each other under one parent, with others between


MAX_DEPTH = 256  # of the paths that tell how near two blocks are


class Block:
    """Text of one element, with the numbers of the elements around it, the outermost first."""

    __slots__ = ("text", "path", "tag", "signs", "linked")

    def __init__(self, text: str, path: tuple[int, ...], tag: str, signs: tuple[bool, bool, bool], linked: int):
        self.text, self.path, self.tag, self.signs, self.linked = text, path, tag, signs, linked


def score(b: Block, has_article: bool) -> float:
    """Log odds of content; ``has_article``: some block of the page is marked as the article's."""
    w = WEIGHTS
    boilerplate, article, named = b.signs
    total = w["bias"] + w["words"] * min(len(b.text.split()).bit_length(), 8) + w["links"] * b.linked / max(len(b.text), 1)
    total += w["boilerplate"] * boilerplate + w["article"] * article + w["named"] * named
    total += w["outside"] * (has_article and not article)
    if b.tag == "p":
        total += w["p"]
    elif b.tag[:1] == "h" and b.tag[1:].isdigit():
        total += w["heading"]
    elif b.tag in ("li", "dt", "dd", "td", "th", "option"):
        total += w["item"]
    if b.text[-1] in ".!?\"”…":
        total += w["stop"]
    if "©" in b.text:
        total += w["rights"]
    return total


def blocks(html: str) -> list[Block]:
    """The page's blocks in order; markup, comments, scripts, styles and the like left out."""
    out: list[Block] = []
    # (tag, numbers of the element and those around it, (boilerplate, article, named))
    stack: list[tuple[str, tuple[int, ...], tuple[bool, bool, bool]]] = [("", (0,), (False, False, False))]
    pieces: list[str] = []
    count = link = linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                tag, path, signs = stack[-1]
                out.append(Block(text, path, tag, signs, linked))
            pieces.clear()
        linked = 0

    last = 0
    for m in TOKEN.finditer(html):
        if m.start() > last:
            pieces.append(html[last : m.start()])
            if link:
                linked += m.start() - last
        last = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "a":
            link = 0 if m["end"] else 1
        if tag in INLINE:
            continue
        if tag == "br":
            pieces.append("\n")
            continue
        flush()
        link = 0
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_ITSELF and stack[-1][0] == tag:
            stack.pop()
        boilerplate, article, named = stack[-1][2]
        names = " ".join(a or b or c for a, b, c in NAMES.findall(m["attrs"])) if m["attrs"] else ""
        body = tag in ("html", "body")
        bad = tag in BOILERPLATE_TAGS or (tag == "header" and not article)
        bad = bad or (bool(names) and not body and tag not in ("article", "main") and bool(BOILERPLATE_NAMES.search(names)))
        good = tag in ("article", "main") or "main" == names.strip().lower()
        count += 1
        signs = (boilerplate or bad, article or good, named or (bool(names) and not body and bool(CONTENT_NAMES.search(names))))
        # beyond MAX_DEPTH elements count as one
        path = stack[-1][1]
        stack.append((tag, (*path, count) if len(path) < MAX_DEPTH else path, signs))
    rest = html[last:]
    pieces.append(rest)
    flush()
    return out


def max_flow_side(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Source side of a minimum cut: True for content. Ties fall to boilerplate's favour.

    ``unary`` > 0 is the capacity from the source, < 0 that to the sink. Each phase
    finds the distances from the source and then saturates all shortest paths; a
    place that leads no further is not tried again in the phase.
    """
    n = len(unary)
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(forth)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, u in enumerate(unary):
        if u > 0:
            join(source, i, u, 0.0)
        elif u < 0:
            join(i, sink, -u, 0.0)
    for a, b, c in edges:
        join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in out[x]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)  # the edge each place tries next
        path: list[int] = []
        x = source
        while True:
            if x == sink:
                flow = min(cap[e] for e in path)
                cut = len(path)
                for k, e in enumerate(path):
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                    if cap[e] <= 1e-9 and k < cut:
                        cut = k
                # go on from before the first edge that is full
                x = to[path[cut] ^ 1]
                del path[cut:]
                continue
            own = out[x]
            while turn[x] < len(own):
                e = own[turn[x]]
                if cap[e] > 1e-9 and level[to[e]] == level[x] + 1:
                    break
                turn[x] += 1
            if turn[x] < len(own):
                path.append(e)
                x = to[e]
            elif path:
                x = to[path.pop() ^ 1]
                turn[x] += 1
            else:
                break


def smoothness(page: list[Block]) -> list[tuple[int, int, float]]:
    """Edges (block, later block, capacity): neighbours in the text, and in the tree."""
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, block in enumerate(page):
        if i:
            before, own = page[i - 1].path, block.path
            shared = 0
            for a, b in zip(before, own):
                if a != b:
                    break
                shared += 1
            steps = len(before) + len(own) - 2 * shared
            edges.append((i - 1, i, NEXT + TREE * 0.5 ** max(steps - 2, 0)))
        parent = block.path[-2] if len(block.path) > 1 else block.path[-1]
        if last.get(parent, i) < i - 1:
            edges.append((last[parent], i, APART))
        last[parent] = i
    return edges


def label(page: list[Block]) -> list[bool]:
    """Whether each block is content."""
    n = len(page)
    has_article = any(b.signs[1] for b in page)
    unary = [score(b, has_article) for b in page]
    side: list[bool | None] = [None] * n
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in smoothness(page):
        near[a][b] = near[b][a] = c
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if side[i] is None and abs(unary[i]) > sum(near[i].values()):
            side[i] = unary[i] > 0
            for j, c in near[i].items():
                unary[j] += c if side[i] else -c
                del near[j][i]
                todo.append(j)
    open_ones = [i for i in range(n) if side[i] is None]
    if open_ones:
        number = {i: k for k, i in enumerate(open_ones)}
        left = [(number[i], number[j], c) for i in open_ones for j, c in near[i].items() if i < j]
        for i, s in zip(open_ones, max_flow_side([unary[i] for i in open_ones], left)):
            side[i] = s
    return [bool(s) for s in side]


def main_text(html: str) -> str:
    page = blocks(html)
    return "\n\n".join(b.text for b, keep in zip(page, label(page)) if keep)


def _extracted(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "html", 8 << 20):
                texts = [main_text(html) if html else "" for html in part.column("html").to_pylist()]
                own = [part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string())], names=[*names, "text"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """``pages(..., html, ...)`` without html, plus text: the blocks of the main text.

    White space inside a block is one space; blocks are joined by two line feeds,
    in page order. A null or empty page gives the empty text. A column ``text`` of
    ``pages`` is replaced. Every row is read by itself, whole.
    """
    kept = [c for c in pages.columns if c not in ("html", "text")]
    fields = pages.select(*kept).schema.fields if kept else []
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "text string"])
    return pages.select(*kept, "html").mapInArrow(_extracted(kept), schema)
