"""Main text of web pages, by consensus of the pages of a host.

First every page scores its own containers by the text of their blocks. From the best one it
climbs to the whole article around it, votes for that one's generalised tag-class path, and Spark
adds up the votes by host. Then each page is read again and the container on its host's winning
path is taken, with what of the article stands around it on this page; a page without that path
falls back to its own best container. Only hosts whose pages disagree need a path sent back; where
all vote for one, each page's own vote is the winner.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commonloom.llm.common import arrow_slices, attach_keyed, carried, checkpointed, text_of, with_columns_back

#: Names of HTML elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset("aside audio button canvas dialog embed footer form head iframe input map menu nav noscript object script select style svg template textarea title video".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CONTAINERS = frozenset("article body center div main section td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEADLINES = frozenset("h1 h2".split())
#: Words of a class, id or role that mark what isn't part of an article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu menus modal nav navbar navigation newsletter notice notices overlay "
    "pager pagination popup promo promoted promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)

#: Words that may stand beside those in a name without giving it another meaning; `share-price` is about something else.
PARTS = frozenset(
    "all area article articles author bar block body bottom box btn button buttons by col column container content count desktop entry field first fixed form global group head header holder icon icons id in info inline inner item items js "
    "last left level link links list lower main message meta mobile more of on outer page panel policy post posts primary reader readers recent right row secondary section site small sticky stories story sub text the thread title to tool tools "
    "top upper user users view wrap wrapper".split()
)
#: What of them marks an `article` too.
COMMENTS = frozenset("comment comments replies reply respond".split())

#: Hosts with several paths up to which their paths are broadcast (some tens of MB); with more, the pages of such hosts are shuffled.
HOSTS = 200_000

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TO_QUOTE, _TO_ANGLE = re.compile(r"""[^>"']*"""), re.compile(r"[^<>]*>?")
_ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_CLOSE = {name: re.compile(f"</{name}", re.I) for name in RAW}
#: What a tag ends of what is open around it, up to the next of the tags in `SCOPES`.
ENDS = {name: ("p",) for name in BLOCK} | {"br": (), "body": ("p", *sorted(HEADINGS))} | {name: ("p", *sorted(HEADINGS)) for name in HEADINGS}
ENDS |= {"li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "tr": ("p", "tr", "td", "th")}
ENDED = frozenset(t for tags in ENDS.values() for t in tags)
SCOPES = frozenset("ul ol dl table div section article main body blockquote".split())
SPEAK_OF = frozenset("has have with without no not".split())
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")


class Node:
    """An element; `parts` are texts, nodes, and None where a block begins or ends. `mark`: 2 if its names mark it, 1 if they may."""

    __slots__ = ("tag", "step", "dropped", "mark", "parent", "parts", "score")

    def __init__(self, tag: str, step: str, dropped: bool, mark: int, parent: Node | None) -> None:
        self.tag, self.step, self.dropped, self.mark, self.parent = tag, step, dropped, mark, parent
        self.parts: list = []
        self.score = 0.0

    def path(self) -> str:
        steps, node = [], self
        while node is not None and node.parent is not None:
            steps.append(node.step)
            node = node.parent
        return "/".join(reversed(steps))


def _marked(name: str, attributes: dict[str, str]) -> int:
    """Does a class, id or role name something that isn't article (2), or may it (1)? `has-sidebar` and the like only speak of it."""
    marks, found = COMMENTS if name == "article" else MARKS, 2 if "hidden" in attributes else 0
    for a in ("class", "id", "role"):
        for one in attributes.get(a, "").split():
            words = _WORD.findall(one)
            if words and words[0] not in SPEAK_OF and not marks.isdisjoint(words):
                found = max(found, 2 if all(w in MARKS or w in PARTS for w in words) else 1)
    return found


def _tag_end(page: str, at: int) -> int:
    """Where a tag's `>` stands that isn't quoted, or -1."""
    while True:
        at = _TO_QUOTE.match(page, at).end()
        if at == len(page):
            return -1
        if page[at] == ">":
            return at
        at = page.find(page[at], at + 1) + 1
        if not at:
            return -1


def parse(page: str) -> Node:
    """A tree of the page; unclosed and stray tags are taken as browsers mostly do. Takes time in proportion to the page's length.

    Once a tag's end or closing quote is missing, the rest of the page is read without regard to quotes.
    """
    root = Node("", "", False, 0, None)
    stack, is_open, scopes = [root], dict.fromkeys((), 0), [{}]
    at, n, quoted, some_end = 0, len(page), True, True

    def shorten(size: int) -> None:
        while len(stack) > size:
            tag = stack.pop().tag
            is_open[tag] -= 1
            if tag in SCOPES:
                scopes.pop()
            elif tag in ENDED:
                scopes[-1][tag].pop()

    while at < n:
        start = page.find("<", at)
        if start < 0:
            stack[-1].parts.append(page[at:])
            break
        following = page[start + 1 : start + 2]
        if following in ("!", "?"):
            if start > at:
                stack[-1].parts.append(page[at:start])
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = end + 3 if end >= 0 else n
            else:
                end = page.find(">", start) if some_end else -1
                some_end = end >= 0
                at = end + 1 if some_end else start + 2
            continue
        found = _NAME.match(page, start + (2 if following == "/" else 1))
        if found is None:
            stack[-1].parts.append(page[at : start + 1])
            at = start + 1
            continue
        if start > at:
            stack[-1].parts.append(page[at:start])
        name = found[0].lower()
        end = -1
        if some_end and quoted:
            end = _tag_end(page, found.end())
            if end < 0:
                quoted, some_end = False, page.find(">", start) >= 0
        if end < 0:
            at = _TO_ANGLE.match(page, found.end()).end()
            if quoted or page[at - 1] != ">":
                continue  # a tag without an end
            end = at - 1
        at = end + 1
        if following == "/":
            if is_open.get(name):
                size = len(stack) - 1
                while stack[size].tag != name:
                    size -= 1
                shorten(size)
            if name in BLOCK:
                stack[-1].parts.append(None)
            continue
        if name in BLOCK:
            scope = scopes[-1]
            shorten(min((scope[t][0] for t in ENDS[name] if scope.get(t)), default=len(stack)))
            stack[-1].parts.append(None)
        if name in VOID:
            continue
        here, text = stack[-1], page[found.end() : end]
        attributes = {k.lower(): (a or b or c).lower() for k, a, b, c in _ATTRIBUTE.findall(text)} if "=" in text else {}
        if "hidden" in text.lower().split():
            attributes["hidden"] = ""
        kinds = sorted(_DIGITS.sub("#", c) for c in attributes.get("class", "").split())
        mark = _marked(name, attributes) if attributes and name not in ("html", "body", "main") else 0
        node = Node(name, ".".join([name, *kinds]), name in DROPPED and name != "form", 2 if name == "form" else mark, here)
        here.parts.append(node)
        if name in RAW:
            close = _CLOSE[name].search(page, at)
            close = page.find(">", close.end()) if close else -1
            at = close + 1 if close >= 0 else n
        elif not text.endswith("/"):
            if name in SCOPES:
                scopes.append({})
            elif name in ENDED:
                scopes[-1].setdefault(name, []).append(len(stack))
            is_open[name] = is_open.get(name, 0) + 1
            stack.append(node)
    settle(root)
    return root


def settle(root: Node) -> None:
    """Drops the marked nodes, from the inside out, but for those that may mean something else.

    A name that only contains a mark counts if no more than half of the letters stand outside of
    links. A marked node or a form stays, without its own marked parts, if it holds the page's
    `main` or a top heading and more letters outside of links than in them.
    """
    inside: dict[int, tuple[int, int, bool]] = {}
    todo: list[tuple[Node, bool, bool]] = [(root, False, False)]
    while todo:
        node, linked, done = todo.pop()
        if node.dropped:
            continue
        linked = linked or node.tag == "a"
        if not done:
            todo.append((node, linked, True))
            todo += [(c, linked, False) for c in node.parts if isinstance(c, Node)]
            continue
        free = link = 0
        main = node.tag in ("main", "h1")
        for part in node.parts:
            if isinstance(part, str):
                size = len(part.strip())
                free, link = (free, link + size) if linked else (free + size, link)
            elif part is not None and not part.dropped:
                f, k, m = inside.pop(id(part))
                free, link, main = free + f, link + k, main or m
        node.dropped = bool(node.mark) and (free <= link if node.mark == 1 else not (main and free > link))
        inside[id(node)] = (free, link, main)


def blocks_of(node: Node, in_header: bool = False) -> list[str]:
    """The texts of a node's blocks in page order, without what isn't article; of a header only its headings."""
    blocks: list[list[str]] = [[]]
    todo: list[tuple[Iterator, bool]] = [(iter(node.parts), in_header)]
    while todo:
        parts, muted = todo[-1]
        for part in parts:
            if part is None:
                blocks.append([])
            elif isinstance(part, str):
                if not muted:
                    blocks[-1].append(part)
            elif not part.dropped:
                todo.append((iter(part.parts), (muted or part.tag == "header") and part.tag not in HEADINGS))
                break
        else:
            todo.pop()
    texts = (" ".join(html.unescape("".join(b)).split()) for b in blocks if b)
    return [t for t in texts if t]


def containers(root: Node) -> list[Node]:
    """The page's containers with their scores: a block's length counts in full for the nearest container, by a third for the next, and so on."""
    found: list[Node] = []
    todo: list[tuple[Node, Node | None, bool]] = [(root, None, False)]
    above: dict[int, Node | None] = {}
    while todo:
        node, around, linked = todo.pop()
        if node.dropped:
            continue
        if node.tag in CONTAINERS:
            above[id(node)] = around
            found.append(node)
            around = node
        linked = linked or node.tag in ("a", "header")
        size = 0
        for part in node.parts:
            if isinstance(part, str):
                size += 0 if linked else len(part.strip())
            elif part is not None:
                todo.append((part, around, linked))
        share, holder = float(size), around
        while holder is not None and share >= 1:
            holder.score += share
            share /= 3
            holder = above[id(holder)]
    for node in found:
        if node.tag in ("article", "main"):
            node.score *= 2
    return found


def best_container(root: Node) -> Node | None:
    found = [c for c in containers(root) if c.score > 0]
    return max(found, key=lambda c: c.score) if found else None


def measured(root: Node) -> dict[int, tuple[int, int, bool]]:
    """By kept node (its `id`): letters outside and inside links, and whether it has a heading; of a header only its headings count.

    Linked headlines count as outside.
    """
    out: dict[int, tuple[int, int, bool]] = {}
    todo: list[tuple[Node, bool, bool, bool, bool]] = [(root, False, False, False, False)]
    while todo:
        node, linked, muted, headline, done = todo.pop()
        if not done:
            headline = headline or node.tag in HEADLINES
            linked = (linked or node.tag == "a") and not headline
            muted = (muted or node.tag == "header") and node.tag not in HEADINGS
            todo.append((node, linked, muted, headline, True))
            todo += [(c, linked, muted, headline, False) for c in node.parts if isinstance(c, Node) and not c.dropped]
            continue
        free = link = 0
        heading = False
        for part in node.parts:
            if isinstance(part, str):
                size = 0 if muted else len(part.strip())
                free, link = (free, link + size) if linked else (free + size, link)
            elif part is not None and not part.dropped:
                f, k, has = out[id(part)]
                free, link, heading = free + f, link + k, heading or has
        out[id(node)] = (free, link, heading or (node.tag in HEADINGS and free + link > 0))
    return out


class Articles:
    """Finds the articles that containers are the longest parts of, on one page."""

    def __init__(self, root: Node) -> None:
        self.root = root
        self.sizes: dict[int, tuple[int, int, bool]] | None = None
        self.known: dict[int, tuple[int, int, int, int, int]] = {}
        self.climbed: dict[tuple[int, bool, bool, bool], Node | None] = {}

    def _size(self, node: Node) -> tuple[int, int, bool]:
        if self.sizes is None:
            self.sizes = measured(self.root)
        return self.sizes[id(node)]

    def _adds(self, part: object) -> bool:
        """Is it text, other than links and marks?"""
        if isinstance(part, str):
            return any(map(str.isalnum, part))
        return part is not None and not part.dropped and self._size(part)[0] > self._size(part)[1]

    def _facts(self, part: object) -> tuple[int, int, int, int, int]:
        """Whether a part adds text, does so on its own account, has a heading and adds, has one on its own account, and is a section that adds."""
        if not self._adds(part):
            return (0, 0, 0, 0, 0)
        node = part if isinstance(part, Node) else None
        own = node is None or not (node.tag in CONTAINERS or node.tag == "header")
        headed = node is not None and self._size(node)[2]
        return (1, int(own), int(headed), int(own and headed), int(node is not None and node.tag == "section"))

    def _beside(self, child: Node) -> tuple[int, ...]:
        """The facts of all parts beside a node, added up."""
        above = child.parent
        if id(above) not in self.known:
            self.known[id(above)] = tuple(map(sum, zip(*map(self._facts, above.parts), strict=True)))
        return tuple(a - b for a, b in zip(self.known[id(above)], self._facts(child), strict=True))

    def _climb(self, best: Node, inside: bool) -> Node:
        """The outermost node around `best` that its article goes up to, below the body."""
        steps: list[tuple[tuple[int, bool, bool, bool], Node | None]] = []
        child, between, headed, last = best, False, self._size(best)[2], None
        while child.parent is not None and child.parent.tag not in ("html", "body", ""):
            state = (id(child), inside, between, headed)
            if state in self.climbed:
                last = self.climbed[state]
                break
            above, taken = child.parent, None
            adds, own, _, own_headed, _ = self._beside(child)
            if not inside:
                taken = above if adds else None
            else:
                between = between or own > 0
                if (above.tag in ("article", "main") and between) or (own_headed and not headed):
                    taken = above
            steps.append((state, taken))
            if taken is not None:
                between, headed = False, self._size(taken)[2]
            child = above
        for state, taken in reversed(steps):
            last = last if last is not None else taken
            self.climbed[state] = last
        return last if last is not None else best

    def whole(self, node: Node, to_body: bool = True) -> Node:
        """The article that a container is the longest part of.

        That is the nearest article or main around it, or the next one if text stands between the
        two; a headline beside an article that has none belongs to it. Where there is neither, it is
        the outermost ancestor inside the body that adds text other than lists of links, and with
        `to_body` the body itself if such text stands right in it, if that comes from a section beside
        a section, or if it has the heading that the container lacks.
        """
        best = node
        while best is not None and best.tag not in ("article", "main"):
            best = best.parent
        inside = best is not None
        best = self._climb(best if inside else node, inside)
        if not to_body or best.tag in ("main", "html", "body", ""):
            return best
        top = best
        while top.parent is not None and top.parent.tag not in ("html", "body", ""):
            top = top.parent
        if top.parent is None:
            return best
        _, own, headed, own_headed, sections = self._beside(top)
        lacks = headed > 0 and not self._size(best)[2]
        if inside:
            return top.parent if lacks and own_headed else best
        return top.parent if lacks or own or (sections and top.tag == "section") else best

    def all(self, nodes: list[Node]) -> list[Node]:
        """The articles of some containers in page order, each once, and none inside another."""
        found: list[Node] = []
        covered: set[int] = set()
        for node in nodes:
            if id(node) not in covered:
                whole = self.whole(node)
                found = [f for f in found if f is not whole]
                found.append(whole)
                todo = [whole]
                while todo:
                    one = todo.pop()
                    if id(one) not in covered:
                        covered.add(id(one))
                        todo += [p for p in one.parts if isinstance(p, Node)]
        tops = {id(f) for f in found}

        def outermost(node: Node) -> bool:
            up = node.parent
            while up is not None and id(up) not in tops:
                up = up.parent
            return up is None

        return [f for f in found if outermost(f)] if len(found) > 1 else found


def on_path(root: Node, path: str) -> list[Node]:
    """The outermost kept nodes on a generalised path, in page order."""
    level = [root]
    for step in path.split("/"):
        level = [c for node in level for c in node.parts if isinstance(c, Node) and c.step == step and not c.dropped]
    return level


def own_path(root: Node, best: Node | None) -> str:
    """The path that a page votes for, that of the whole article around its best container."""
    return Articles(root).whole(best, to_body=False).path() if best is not None else ""


def extract(page: str, path: str | None) -> str:
    """The main text of a page, with its host's winning path, or its own one if there is none."""
    root = parse(page)
    best = best_container(root) if not path else None
    on = on_path(root, path or own_path(root, best))
    text = " ".join(t for node in (Articles(root).all(on) if on else ()) for t in blocks_of(node))
    if text:
        return text
    best = best or best_container(root)
    return " ".join(t for node in (Articles(root).all([best]) if best is not None else [root]) for t in blocks_of(node))


def page_vote(page: str) -> tuple[str, float]:
    root = parse(page)
    best = best_container(root)
    return own_path(root, best), best.score if best is not None else 0.0


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#\s]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The winning path of each host whose pages vote for different ones: `_host`, `_path`, by number of pages, then by score, then by the path itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_slices(batches, html_col):
            votes = [page_vote(p) if p else ("", 0.0) for p in part.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_pydict({"_host": part.column("_host"), "_path": pa.array([v for v, _ in votes], pa.string()), "_score": np.array([s for _, s in votes], dtype=np.float64)})

    votes = pages.select(_host(F.col(url_col)).alias("_host"), html_col).mapInArrow(run, "_host string, _path string, _score double").where("_path <> ''")
    counted = votes.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("_pages"), F.sum(F.round("_score").cast("long")).alias("_score"))
    best = counted.groupBy("_host").agg(F.max(F.struct("_pages", "_score", "_path")).alias("_best"), F.count(F.lit(1)).alias("_paths"))
    return best.where("_paths > 1").select("_host", F.col("_best._path").alias("_path"))


def html_extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", new_text: str = "text") -> DataFrame:
    """All rows and columns of `pages` with the main text and `n_chars`, its code points.

    Null html counts as empty and gives an empty text; pages without a url share one nameless
    host. Of containers with the same score the first on the page is taken. Any page, however long
    or broken, takes time in proportion to its length. Repeated rows each give a row; an empty table gives an empty result. Columns named as
    the new ones are replaced.
    """
    rows = pages.select(carried(pages, new_text, "n_chars", needed=(url_col, html_col)), _host(F.col(url_col)).alias("_host"))
    paths = checkpointed(host_paths(pages, url_col, html_col))
    joined = rows.join(F.broadcast(paths), "_host", "left") if paths.count() <= HOSTS else attach_keyed(rows, paths, ["_host"])
    joined = joined.select("_row", "_path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_slices(batches, html_col):
            texts = [extract(p, path) if p else "" for p, path in zip(text_of(part, html_col).to_pylist(), part.column("_path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"_row": part.column("_row"), new_text: pa.array(texts, pa.string()), "n_chars": np.array([len(t) for t in texts], dtype=np.int64)})

    schema = T.StructType([joined.schema["_row"], T.StructField(new_text, T.StringType()), T.StructField("n_chars", T.LongType())])
    return with_columns_back(joined.mapInArrow(run, schema), new_text, "n_chars")


def op9(pages: DataFrame) -> DataFrame:
    return html_extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
