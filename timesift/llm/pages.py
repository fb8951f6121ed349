"""Main text of web pages by consensus paths of their hosts.

Containers of each page are scored, their generalised tag-class paths are voted on per host, and each
page is extracted again from the containers at its host's winning path.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timesift.llm.common import cut_lineage, host_of

START = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][A-Za-z0-9:-]*))")
STOP = re.compile(r"""[>]|=\s*(["'])""")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
READ = {"class", "id", "role", "hidden", "aria-hidden", "style"}

# Element kinds of HTML.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "textarea", "select", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CONTAINERS = {"html", "body", "main", "article", "section", "div", "td", "table", "tbody", "tr", "center"}
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "pre", "blockquote", "figure", "figcaption",
          "address", "th", "caption", "details", "summary", "hr", "fieldset", "option", "thead", "tfoot", "head"}
DROPPED = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "label", "input", "head"}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu"}
DROPPED_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "consent", "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notices", "popup", "promo", "promoted", "promotion", "recommended", "related", "replies", "respond", "share", "sharing", "sidebar",
    "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget"}


# End tags that a page may leave out: what a start tag closes, and what the search for it does not leave.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "td": ({"td", "th", "caption"}, {"table", "tr"}), "th": ({"td", "th", "caption"}, {"table", "tr"}), "tr": ({"tr", "caption"}, {"table"}),
          **{t: ({"thead", "tbody", "tfoot", "caption"}, {"table"}) for t in ("thead", "tbody", "tfoot")}}
SECTIONS = {"html", "body", "main", "article", "section", "table", "td", "th", *DROPPED}
IN_HEAD = {"head", "html", "base", "link", "meta"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
READERS = {"comment", "comments", "disqus", "replies", "respond"}
SENTENCE_END = tuple(".!?…。！？؟।")
CLIMB = 5
"""A host's path climbs to an ancestor that one page in ``CLIMB`` needs."""


def _attributes(text: str) -> dict[str, str]:
    """Attributes that are read, by whole names: names and values are taken together from left to right, the first of a name counts."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        name = m[1].lower()
        if name in READ:
            found.setdefault(name, m[2] or m[3] or m[4] or "")
    return found


def _boilerplate(tag: str, attributes: dict[str, str]) -> bool:
    """By element, role or hiding, whatever it holds."""
    if tag in DROPPED or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    return attributes.get("role", "").lower() in DROPPED_ROLES or bool(re.search(r"display\s*:\s*none", attributes.get("style", "")))


def _listed_words(attributes: dict[str, str]) -> set[str]:
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return {w.lower() for w in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", names) if w} & DROPPED_WORDS


def _step(tag: str, attributes: dict[str, str]) -> str:
    """Tag and classes, with numbers taken for the same: pages of one template share their steps. ``/`` joins steps and is escaped in classes."""
    classes = sorted({re.sub(r"\d+", "0", c).replace("%", "%25").replace("/", "%2F") for c in attributes.get("class", "").split()})
    return ".".join([tag, *classes])


def _good(text: str, linked: int, heading: bool) -> bool:
    """A block that reads like a part of an article: mostly unlinked, and a first heading, a sentence or long."""
    return 2 * linked < len(text) and (heading or len(text) >= 50 or len(text) >= 20 and text.endswith(SENTENCE_END))


class Block(NamedTuple):
    node: int  # innermost open container
    text: str
    linked: int  # characters inside links
    heading: bool  # in h1
    mark: int  # innermost element marked by class words, 0 for none
    in_article: bool


class Mark(NamedTuple):
    above: int  # the marked element around it, 0 for none
    words: set[str]


class Page:
    """Blocks of a page in page order, in a tree of containers and a tree of their paths.

    Nodes and paths are numbers with their parents, so that depth costs nothing; parents come before children, and number 0 is the page.
    """

    def __init__(self):
        self.blocks: list[Block] = []
        self.parents, self.node_paths = [0], [0]
        self.path_parents, self.steps, self.depths, self.prints = [0], [""], [0], [0]
        self._known: dict[tuple[int, str], int] = {}

    def node(self, parent: int, step: str) -> int:
        above = self.node_paths[parent]
        path = self._known.get((above, step))
        if path is None:
            path = self._known[above, step] = len(self.steps)
            self.path_parents.append(above)
            self.steps.append(step)
            self.depths.append(self.depths[above] + 1)
            self.prints.append(xxhash.xxh64_intdigest(step, seed=self.prints[above]))
        self.parents.append(parent)
        self.node_paths.append(path)
        return len(self.parents) - 1

    def path_of(self, block: Block) -> int:
        return self.node_paths[block.node]

    def print_of(self, block: Block) -> int:
        """A number of the block's path that is the same on all pages."""
        return self.prints[self.path_of(block)] >> 1

    def written(self, path: int) -> str:
        steps = []
        while path:
            steps.append(self.steps[path])
            path = self.path_parents[path]
        return "/".join(reversed(steps))

    def inside(self, wanted: str) -> list[bool]:
        """For each path, whether it is at or below the written path ``wanted``."""
        steps = wanted.split("/") if wanted else []
        leads, inner = [True], [not steps]
        for p in range(1, len(self.steps)):
            above, depth = self.path_parents[p], self.depths[p]
            leads.append(leads[above] and depth <= len(steps) and self.steps[p] == steps[depth - 1])
            inner.append(inner[above] or depth == len(steps) and leads[p])
        return inner


def _lowest(parents: list[int], members: list[int]) -> int:
    """The lowest node around all members: nodes that hold all of them lie on one line, parents first."""
    held = [0] * len(parents)
    for m in members:
        held[m] += 1
    for n in range(len(parents) - 1, 0, -1):
        if held[n] == len(members):
            return n
        held[parents[n]] += held[n]
    return 0


def _wrappers(blocks: list[Block], marks: list[Mark], holds: list[set[str]]) -> list[bool]:
    """For each element marked by class words, whether it and all marked ones around it wrap the article.

    They hold main, or more of the page's unlinked text than what no mark covers, where text of an
    article counts threefold; a fourth of it is enough around an article; reader comments need ten times as much.
    """
    own, inside, good = [0.0] * len(marks), [0] * len(marks), [False] * len(marks)
    total = 0
    for b in blocks:
        free = len(b.text) - b.linked
        total += free
        own[b.mark] += free * (3 if b.in_article else 1)
        inside[b.mark] += free
        good[b.mark] |= _good(b.text, b.linked, b.heading)
    for m in range(len(marks) - 1, 0, -1):
        above = marks[m].above
        inside[above] += inside[m]
        good[above] |= good[m]
        holds[above] |= holds[m]
    kept, outside = [True], [0.0]
    for m in range(1, len(marks)):  # outer elements first
        above = marks[m].above
        outside.append(outside[above] + own[above])
        held = inside[m]
        wraps = "main" in holds[m] or good[m] and ("article" in holds[m] and 4 * held >= outside[m] or 2 * held > total and held > outside[m] * (
            10 if marks[m].words & READERS else 1))
        kept.append(kept[above] and wraps)
    return kept


class _Open(NamedTuple):
    tag: str
    node: int  # innermost container, itself included
    gone: bool
    mark: int
    article: bool


def _tag_end(source: str, at: int, quotes: bool) -> int:
    """Where the tag whose name ends at ``at`` ends; -1 when a quoted value never does."""
    if not quotes:
        return source.find(">", at)
    while True:
        m = STOP.search(source, at)
        if m is None:
            return -1
        if m[1] is None:
            return m.start()
        close = source.find(m[1], m.end())
        if close < 0:
            return -1
        at = close + 1


def blocks_of(source: str | None) -> Page:
    """The blocks of a page, in time in proportion to its length.

    Boilerplate elements are gone already. Unclosed elements end where HTML ends them, or with the container around them. After a
    quoted value that never ends, tags end at the next ``>``, whatever their quotes; a ``<`` that no tag follows is text.
    """
    source = source or ""
    page, link, at = Page(), 0, 0
    stack = [_Open("", 0, False, 0, False)]
    places: dict[str, list[int]] = {}  # where each kind of element is open
    dropped = article = 0
    marks, holds = [Mark(0, set())], [set()]
    text: list[str] = []
    linked, quotes, last = 0, True, source.rfind(">")

    def flush() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        if joined and not dropped:
            page.blocks.append(Block(stack[-1].node, joined, min(linked, len(joined)), any(e.tag == "h1" for e in stack[-3:]),
                                     stack[-1].mark, article > 0))
        text.clear()
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked
        if piece and stack[-1].tag == "head" and not piece.isspace():
            close(len(stack) - 1)
        if piece and not dropped:
            plain = html.unescape(piece) if "&" in piece else piece
            text.append(plain)
            linked += len(plain) if link else 0

    def open_(tag: str, attributes: dict[str, str]) -> None:
        nonlocal dropped, article
        gone = _boilerplate(tag, attributes)
        words = _listed_words(attributes) if attributes and not gone else set()
        semantic = tag in ("main", "article")
        mark = stack[-1].mark
        if semantic and not gone and not words and not dropped:
            holds[mark].add(tag)
        if words and not dropped and not semantic and tag not in ("html", "body"):
            marks.append(Mark(mark, words))
            holds.append(set())
            mark = len(marks) - 1
        counted = semantic and not words
        article += counted
        dropped += gone
        node = page.node(stack[-1].node, _step(tag, attributes)) if tag in CONTAINERS else stack[-1].node
        places.setdefault(tag, []).append(len(stack))
        stack.append(_Open(tag, node, gone, mark, counted))

    def close(to: int) -> None:
        """Close all from place ``to`` of the stack on."""
        nonlocal dropped, article
        while len(stack) > to:
            last_open = stack.pop()
            places[last_open.tag].pop()
            dropped -= last_open.gone
            article -= last_open.article

    def place(tags: set[str], stop: set[str]) -> int | None:
        """Where the last of ``tags`` is open, unless one of ``stop`` was opened later."""
        found = max((places[t][-1] for t in tags if places.get(t)), default=0)
        return found if found and all(places[t][-1] <= found for t in stop if places.get(t)) else None

    while True:
        m = START.search(source, at)
        if m is not None and m[1]:
            end = source.find("-->", m.end())
            end, after = (len(source), len(source)) if end < 0 else (end, end + 3)
        elif m is not None:
            end = source.find(">", m.end()) if m[2] and m.end() <= last else -1 if m[2] or m.end() > last else _tag_end(source, m.end(), quotes)
            if end < 0 and not m[2] and m.end() <= last:
                quotes = False
                end = source.find(">", m.end())
            if end < 0:
                say(source[at:m.end()])
                at = m.end()
                continue
            after = end + 1
        say(source[at:m.start() if m else len(source)])
        if m is None:
            break
        at = after
        if not m[4]:
            continue
        tag, closing, rest = m[4].lower(), bool(m[3]), source[m.end():end]
        if tag in RAW:
            if not closing and not rest.rstrip().endswith("/"):
                ended = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(source, at)
                at = ended.end() if ended else len(source)
            continue
        if not closing and stack[-1].tag == "head" and tag not in IN_HEAD:
            close(len(stack) - 1)
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            link = 0 if closing else 1
        elif tag in VOID:
            if tag == "hr":
                flush()
                if stack[-1].tag == "p":
                    close(len(stack) - 1)
        elif tag in CONTAINERS or tag in DROPPED or tag in BLOCKS:
            flush()
            if tag not in BLOCKS or tag == "head":
                link = 0
            if not closing:
                # No block lies inside a paragraph: it is the last open element or none.
                if stack[-1].tag == "p" and tag not in ("button", "label"):
                    close(len(stack) - 1)
                if tag in HEADINGS and stack[-1].tag in HEADINGS:
                    close(len(stack) - 1)
                if tag in CLOSES:
                    ends, stop = CLOSES[tag]
                    i = place(ends, stop | (SECTIONS - ends - {"tr", "td", "th"} if tag in ("li", "dt", "dd") else set()))
                    if i is not None:
                        close(i)
                if not rest.rstrip().endswith("/"):
                    open_(tag, _attributes(rest) if rest else {})
            else:
                tags = HEADINGS if tag in HEADINGS else {tag}
                i = place(tags, SECTIONS if tag in BLOCKS and tag not in SECTIONS else set())
                if i is not None:
                    close(i)
    flush()
    if len(marks) > 1:
        kept = _wrappers(page.blocks, marks, holds)
        page.blocks = [b for b in page.blocks if kept[b.mark]]
    return page


def _worth(step: str) -> float:
    return {"article": 3.0, "main": 2.0}.get(step.split(".")[0], 1.0)


def _path_scores(page: Page) -> dict[int, float]:
    scores: dict[int, float] = {}
    for b in page.blocks:
        weight, path = (len(b.text) - b.linked) + 20.0 * (b.linked == 0), page.path_of(b)
        for up in range(3):
            if not path:
                break
            scores[path] = scores.get(path, 0.0) + weight * 0.5 ** up * _worth(page.steps[path])
            path = page.path_parents[path]
    return scores


def container_scores(page: Page) -> dict[str, float]:
    """Score of each generalised path: its own unlinked text, half of the text one level below, a quarter of two below."""
    return {page.written(p): score for p, score in _path_scores(page).items()}


def _outermost(page: Page, kind: str) -> list[int]:
    """For each path, the first step of ``kind`` on it, 0 for none."""
    out = [0]
    for p in range(1, len(page.steps)):
        out.append(out[page.path_parents[p]] or (p if page.steps[p].split(".")[0] == kind else 0))
    return out


def best_path(page: Page) -> str | None:
    """Path of the lowest container around all blocks that read like an article; "" is the page itself, None a page without text.

    Where articles (else main) hold a third (a half) of that text, their own path. Pages without such blocks
    have the path of the highest score.
    """
    good = [b for b in page.blocks if _good(b.text, b.linked, b.heading)]
    if not good:
        scores = _path_scores(page)
        if not scores:
            return "" if page.blocks else None
        return page.written(min(scores, key=lambda p: (-scores[p], page.depths[p], p)))
    total = sum(len(b.text) - b.linked for b in good)
    for kind, worth in (("article", 3), ("main", 2)):
        outer = _outermost(page, kind)
        boxed = [b for b in good if outer[page.path_of(b)]]
        held = sum(len(b.text) - b.linked for b in boxed)
        if held and worth * held >= total:
            return page.written(_lowest(page.path_parents, list({outer[page.path_of(b)] for b in boxed})))
    return page.written(page.node_paths[_lowest(page.parents, [b.node for b in good])])


def main_text(page: Page, path: str | None, furniture: set[int] | None = None) -> str:
    """Text of the blocks inside containers at ``path``; of the page's own best path when it has none there, and all without containers.

    With ``furniture``, the prints of the paths that a share of the host's pages has, a page climbs for itself: a block outside ``path``
    that reads like an article and whose path is no furniture stays, with what else its container holds.
    """
    inner = page.inside(path) if path is not None else None
    kept = [inner is not None and inner[page.path_of(b)] for b in page.blocks]
    if not any(kept) and page.blocks:
        inner = page.inside(best_path(page))
        kept = [inner[page.path_of(b)] for b in page.blocks]
    elif furniture is not None:
        own = {b.node for b, k in zip(page.blocks, kept, strict=True) if not k and _good(b.text, b.linked, b.heading)
               and page.print_of(b) not in furniture}
        if own:
            around = [False] * len(page.parents)  # containers of what is inside: only their own blocks may join
            for b, k in zip(page.blocks, kept, strict=True):
                around[b.node] |= k
            for n in range(len(around) - 1, 0, -1):
                around[page.parents[n]] |= around[n]
            joins = [0 in own]
            for n in range(1, len(around)):
                above = page.parents[n]
                joins.append(n in own or joins[above] and not around[above])
            kept = [k or joins[b.node] and page.print_of(b) not in furniture for b, k in zip(page.blocks, kept, strict=True)]
    return "\n\n".join(b.text for b, k in zip(page.blocks, kept, strict=True) if k)


def _votes(batches):
    for batch in batches:
        hosts, paths, prints = [], [], []
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = blocks_of(source)
            path = best_path(page)
            if path is not None:
                seen = {page.print_of(b) for b in page.blocks}
                hosts += [host] * (1 + len(seen))
                paths += [path] + [None] * len(seen)
                prints += [None, *seen]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(prints, pa.int64()),
                                          pa.array([1] * len(hosts), pa.int64())], names=["host", "path", "print", "vote"])


def _extract(batches):
    for batch in batches:
        texts = [main_text(blocks_of(source), path, None if known is None else set(known)) for source, path, known in
                 zip(*[batch.column(c).to_pylist() for c in ("html", "path", "furniture")], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("path"),
                                          pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         names=["page_id", "url", "path", "text", "n_chars"])


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, path, furniture``: the path with most votes of each host, climbed to the highest ancestor that one page in ``CLIMB``
    needs, and the prints of the paths that as many pages have (null for a host of fewer pages than ``CLIMB``).

    A page has one vote whatever its length. Votes are added before the shuffle, so a host with a third
    of all pages sends one row a path and task. The winner meets only its own ancestors, a few rows a host; a host has at most ``CLIMB`` times
    as many furniture paths as its pages have paths on average.
    """
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_votes, "host string, path string, print long, vote long")
    counted = cut_lineage(votes.groupBy("host", "path", "print").agg(F.sum("vote").alias("votes")))
    summed = counted.filter("path IS NOT NULL").select("host", "path", "votes")
    won = cut_lineage(summed.groupBy("host").agg(F.max_by("path", F.struct("votes", F.hash("path"), "path")).alias("won"), F.sum("votes").alias("total")))
    above = summed.join(won, "host").filter((F.col("path") == F.col("won")) | (F.col("path") == "") | F.startswith("won", F.concat("path", F.lit("/"))))
    # Pages that voted for a higher ancestor need every ancestor below it too.
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    higher = Window.partitionBy("host").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    needed = above.withColumn("depth", depth).withColumn("need", F.sum("votes").over(higher))
    chosen = needed.filter((F.col("path") == F.col("won")) | (F.col("need") * CLIMB >= F.col("total"))).groupBy("host").agg(
        F.min_by("path", "depth").alias("path"))
    common = counted.filter("print IS NOT NULL").join(won.filter(F.col("total") >= CLIMB).select("host", "total"), "host").filter(
        F.col("votes") * CLIMB >= F.col("total")).groupBy("host").agg(F.collect_list("print").alias("furniture"))
    return cut_lineage(chosen.join(common, "host", "left"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, path, text, n_chars`` of each row of ``pages(page_id, url, html)``.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are
    left out by element, role and class words (words only where the element is no wrapper of the article);
    of the rest, the containers at the host's winning path are taken whole, and on a page of its own making what reads like an
    article beside them. Very long pages take time in proportion to their length; extra columns are not read. Null and empty pages have an empty text; null urls share the empty host;
    repeated rows each vote and return a row; an empty table returns none.
    """
    winners = host_paths(pages)
    narrow = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    # A written side: broadcast while it is small, else a join whose hot hosts Spark can split.
    joined = narrow.join(winners, "host", "left").select("page_id", "url", "path", "furniture", "html")
    ids = "page_id long" if dict(pages.dtypes)["page_id"] == "bigint" else f"page_id {dict(pages.dtypes)['page_id']}"
    return joined.mapInArrow(_extract, f"{ids}, url string, path string, text string, n_chars long")
