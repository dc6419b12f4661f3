"""Main text of web pages: container scores, votes on generalised tag-class paths per host, and re-extraction."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("caption dd dt html body legend li tbody td tfoot th thead tr summary figcaption".split())
#: A start tag of a key ends an open element of its values, within the nearest element of the last set.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table", "tbody", "thead", "tfoot"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
TABLE_PARTS = frozenset("caption tbody td tfoot th thead tr".split())
CELLS = frozenset("caption td th".split())
P_BARRIERS = frozenset("table caption td th button object".split())
IN_HEAD = frozenset("base head html link meta noscript script style template title".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote".split())

#: Elements that are never the article's text.
SKIPPED = frozenset("nav footer aside script style noscript template iframe button select option textarea input head svg canvas object embed audio video map dialog menu search title".split())
#: A class, id or role made of these words alone (and of neutral ones) marks its element in the same way.
MARK_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar banner cookie cookies consent notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion disqus respond "
    "share sharing social related recommended recommendations widget widgets pagination pager toolbar skip complementary contentinfo search".split()
)
#: Of these, words that name an article's parts as well: below the container they leave out only what reads like controls.
WEAK_WORDS = frozenset("menu search share sharing social related navigation promotion header".split())
#: Classes of what stands before the text and belongs to it.
LEAD_WORDS = frozenset("headline title subtitle heading lead lede intro introduction standfirst deck dek abstract teaser summary".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
NEUTRAL_WORDS = frozenset("site page main global top bottom left right primary secondary box bar block slot list area section wrap wrapper container button buttons links link item items form group unit inner outer bottom text gdpr".split())
#: Within these, and where a class or id is one of the names, a header is the article's own.
MAIN = frozenset(["article", "main"])
ARTICLE_NAMES = frozenset("post entry article story hentry content".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?>[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
_WORDS = re.compile(r"[a-z]+|[0-9]+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_STOP = re.compile(r"[.!?\u2026]['\")\u201d\u00bb]*(?= |\Z)")
_DIGITS = re.compile(r"\d+")
_CLOSE = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}


def _mark(token: str) -> int:
    """Of one class, id or role: 2 if its words tell of something beside the article, 3 of readers' comments, 1 if all that
    tell of it are weak, else 0."""
    words = _WORDS.findall(_HUMP.sub("-", token).lower())
    known = [w for w in words if w in MARK_WORDS or w in COMMENT_WORDS]
    if not known or any(w not in MARK_WORDS and w not in COMMENT_WORDS and w not in NEUTRAL_WORDS and not w.isdigit() for w in words):
        return 0
    return 3 if any(w in COMMENT_WORDS for w in known) else 1 if all(w in WEAK_WORDS for w in known) else 2


def _has_sentence(text: str) -> bool:
    """Whether six words and more end with a stop."""
    begin = 0
    for m in _STOP.finditer(text):
        if text.count(" ", begin, m.start()) >= 5:
            return True
        begin = m.end() + 1
    return False


def _describe(tag: str, attributes: str) -> tuple[str, int, bool]:
    """A path step (tag and classes, digits as #), the mark of the names, and whether they are those of an article."""
    classes, mark, own = "", 0, False
    if "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            tokens = html.unescape(m[2] or m[3] or m[4] or "").split()
            if m[1].lower() == "class" and tokens and not classes:
                classes = "." + ".".join(sorted({_DIGITS.sub("#", x.lower()) for x in tokens}))
            for t in set(tokens):
                mark = max(mark, _mark(t))
                own = own or not ARTICLE_NAMES.isdisjoint(_WORDS.findall(t.lower()))
    return tag + classes, 0 if tag in MAIN or tag in ("html", "body") else mark, own


class Page:
    """The elements of a page and its blocks of text in page order. One forward pass; time and space are linear.

    Elements are numbered from 0 (the page) in the order of their start tags. `node` numbers their paths: elements with
    equal steps (tag and classes) all the way up have one number.
    """

    def __init__(self, source: str) -> None:
        self.parent, self.node, self.tag, self.mark, self.own = [-1], [0], [""], [0], [False]
        self.above, self.step = [-1], [""]  # of paths: the path above and the last step
        self._known: dict[tuple[int, str], int] = {}
        self._pieces: list[tuple[int, str, bool] | None] = []  # element, text, in a link; None ends a block
        self._parse(source)
        self._lift()
        self._join()

    def _parse(self, source: str) -> None:
        open_: list[int] = [0]  # elements; those that a misplaced end tag has ended stay, with their tag in ended
        ended: set[int] = set()
        at_depth: dict[str, list[int]] = {}  # depths of the open elements of a tag
        skipped_at = 0  # depth of the outermost skipped element
        own: list[int] = []  # depths of elements in which a header is the article's
        pieces = self._pieces

        def deepest(tags) -> int:
            return max((at_depth[t][-1] for t in tags if at_depth.get(t)), default=0)

        def pop(depth: int) -> None:
            nonlocal skipped_at
            block = False
            while len(open_) > depth:
                e = open_.pop()
                block = block or self.tag[e] in BLOCK
                if e in ended:
                    ended.discard(e)
                else:
                    at_depth[self.tag[e]].pop()
            if skipped_at >= depth:
                skipped_at = 0
            while own and own[-1] >= depth:
                own.pop()
            if block:
                pieces.append(None)

        at, end = 0, len(source)
        while at < end:
            lt = source.find("<", at)
            if lt < 0:
                lt = end
            if lt > at and self.tag[open_[-1]] == "head" and not source[at:lt].isspace():
                pop(at_depth["head"][-1])
            if lt > at and not skipped_at:
                pieces.append((open_[-1], source[at:lt], bool(at_depth.get("a"))))
            if lt == end:
                break
            after = source[lt + 1 : lt + 3]
            name = after[1:] if after[:1] == "/" else after[:1]
            if not (name.isascii() and name.isalpha()):
                if after[:1] not in ("!", "?", "/") or (after[:1] == "/" and not name):
                    # a bare < is text
                    if not skipped_at:
                        pieces.append((open_[-1], "<", bool(at_depth.get("a"))))
                    at = lt + 1
                    continue
                comment = source.startswith("<!--", lt)
                close = source.find("-->", lt + 2) if comment else source.find(">", lt)
                if close < 0:
                    break
                at = close + (3 if comment else 1)
                continue
            m = _TAG.match(source, lt)
            if not m:
                # the page ends within a tag
                break
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                self._end(tag, open_, ended, at_depth, deepest, pop)
                continue
            if at_depth.get("head") and tag not in IN_HEAD:
                pop(at_depth["head"][-1])
            if tag in CLOSES_P and at_depth.get("p") and at_depth["p"][-1] > deepest(P_BARRIERS):
                pop(at_depth["p"][-1])
            if tag in IMPLIED:
                ends, within = IMPLIED[tag]
                barrier = deepest(within)
                depths = [at_depth[t][-1] for t in ends if at_depth.get(t) and at_depth[t][-1] > barrier]
                if depths:
                    pop(min(depths))
            if tag in BLOCK:
                pieces.append(None)
            if tag == "br" and not skipped_at:
                pieces.append((open_[-1], " ", False))
            if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
                continue
            if tag in RAW:
                close = _CLOSE[tag].search(source, at)
                if not close:
                    break
                gt = source.find(">", close.start())
                at = end if gt < 0 else gt + 1
                continue
            if tag == "a" and at_depth.get("a"):
                self._end("a", open_, ended, at_depth, deepest, pop)
            step, mark, is_own = _describe(tag, m[3])
            depth = len(open_)
            if tag == "form" or (tag == "header" and not own):
                mark = max(mark, 2)
            elif 0 < mark < 3 and own and "header" in step:
                mark = 0
            up = open_[-1]
            key = (self.node[up], step)
            node = self._known.get(key)
            if node is None:
                node = self._known[key] = len(self.step)
                self.above.append(key[0])
                self.step.append(step)
            open_.append(len(self.parent))
            at_depth.setdefault(tag, []).append(depth)
            self.parent.append(up)
            self.node.append(node)
            self.tag.append(tag)
            self.mark.append(mark)
            if tag in SKIPPED and not skipped_at:
                skipped_at = depth
            self.own.append(tag in MAIN or (is_own and tag not in ("html", "body")))
            if self.own[-1]:
                own.append(depth)
        pieces.append(None)

    def _end(self, tag: str, open_: list[int], ended: set[int], at_depth: dict[str, list[int]], deepest: Callable, pop: Callable) -> None:
        depths = at_depth.get(tag)
        if not depths:
            if tag == "p":
                self._pieces.append(None)
            elif tag == "br":
                self._pieces.append((open_[-1], " ", False))
            return
        depth = depths[-1]
        if tag in BLOCK or tag in SKIPPED:
            barrier = 0 if tag == "table" else deepest(["table"]) if tag in TABLE_PARTS else deepest(CELLS)
            if depth > barrier or tag in ("body", "html"):
                pop(depth)
        elif depth == len(open_) - 1:
            pop(depth)
        else:
            # an inline element that ends beyond others: it ends, they stay
            ended.add(open_[depth])
            depths.pop()

    def _lift(self) -> None:
        """Takes the marks from elements that hold nearly all of the page's text outside links, and all of it that
        stands in an article, as then the names tell of the layout."""
        sums, articles = [0] * len(self.parent), [0] * len(self.parent)
        for e in range(1, len(sums)):
            self.own[e] = self.own[e] or self.own[self.parent[e]]
        for piece in self._pieces:
            if piece is not None and not piece[2]:
                n = len(piece[1].strip())
                sums[piece[0]] += n
                articles[piece[0]] += n if self.own[piece[0]] else 0
        for e in range(len(sums) - 1, 0, -1):
            sums[self.parent[e]] += sums[e]
            articles[self.parent[e]] += articles[e]
        for e, mark in enumerate(self.mark):
            if mark and sums[e] > sums[0] * (0.8 if mark < 3 else 0.9) and articles[e] == articles[0]:
                self.mark[e] = 0

    def _join(self) -> None:
        """blocks: (block element, text, characters in links)."""
        self.blocks: list[tuple[int, str, int]] = []
        # the nearest block element at or above, and whether an inline element's mark drops the text
        holder, gone = [0], [False]
        for e in range(1, len(self.parent)):
            block = self.tag[e] in BLOCK
            holder.append(e if block else holder[self.parent[e]])
            gone.append(not block and (self.mark[e] > 0 or gone[self.parent[e]]))
        text: list[str] = []
        linked, last = 0, 0
        for piece in self._pieces:
            if piece is not None:
                if not gone[piece[0]]:
                    text.append(piece[1])
                    last = holder[piece[0]]
                    linked += len(piece[1]) if piece[2] else 0
            elif text:
                found = _SPACE.sub(" ", html.unescape("".join(text))).strip()
                if found:
                    self.blocks.append((last, found, linked))
                text, linked = [], 0
        self._pieces = []
        # weak marks stay on what is short or mostly links, and outside articles
        size, links, reads = [0] * len(self.parent), [0] * len(self.parent), [False] * len(self.parent)
        for e, found, n in self.blocks:
            size[e] += len(found)
            links[e] += n
            reads[e] = reads[e] or (not n and _has_sentence(found))
        for e in range(len(size) - 1, 0, -1):
            up = self.parent[e]
            size[up] += size[e]
            links[up] += links[e]
            reads[up] = reads[up] or reads[e]
        self.reads = [2 * b <= a and (r or a - b >= 200) for a, b, r in zip(size, links, reads, strict=True)]
        for e, mark in enumerate(self.mark):
            if mark == 1 and self.own[e] and self.reads[e]:
                self.mark[e] = 0

    def _is_main(self, node: int) -> bool:
        return self.step[node].split(".", 1)[0] in MAIN

    def best_path(self) -> str | None:
        """The container with the most text outside links; a block counts in full for the element around it, half for
        the one above that, and a fourth for each article or main element that is further up. Text in marked elements
        counts a tenth. Empty (the page as a whole) if no container has such text; None for a page without text."""
        marked = [False]
        for e in range(1, len(self.parent)):
            marked.append(marked[self.parent[e]] or self.mark[e] > 0)
        n = len(self.step)
        near, below = [0.0] * n, [0.0] * n  # what counts for the path itself, and for all paths above
        for e, text, linked in self.blocks:
            weight = max(0, len(text) - 2 * linked) + (25 if len(text) > 25 and not linked else 0)
            weight *= 0.1 if marked[e] else 1.0
            node = self.node[e]
            around = self.above[node] if node and self.step[node].split(".", 1)[0] in LEAVES else node
            near[around] += weight
        scores = list(near)
        for node in range(n - 1, 0, -1):
            up = self.above[node]
            below[up] += below[node] + near[node]
            scores[up] += 0.5 * near[node]
        # of what is further up than the element above, a fourth
        direct = [0.0] * n
        for node in range(1, n):
            direct[self.above[node]] += near[node]
        best = 0
        for node in range(1, n):
            if self._is_main(node):
                scores[node] = 1.5 * (scores[node] + 0.25 * (below[node] - direct[node]))
            if scores[node] > scores[best]:
                best = node
        if not best:
            return "" if self.blocks else None
        steps, node, whole = [], best, best
        while node > 0:
            # a part of an article stands for the whole
            if self._is_main(node):
                whole = node
                break
            node = self.above[node]
        node = whole
        while node > 0:
            steps.append(self.step[node])
            node = self.above[node]
        return ">".join(reversed(steps))

    def text(self, path: str | None) -> str | None:
        """The blocks in containers of that path, without what is marked below them; None if the page has none."""
        if path is None:
            return None
        target = 0
        for step in path.split(">") if path else ():
            target = self._known.get((target, step), -1)
            if target < 0:
                return None
        inside = [target == 0]
        first = 0
        for e in range(1, len(self.parent)):
            inside.append(self.node[e] == target or (inside[self.parent[e]] and (not self.mark[e] or (self.mark[e] == 1 and self.reads[e]))))
            first = first or (e if inside[e] else 0)
        found = [t for e, t, _ in self.blocks if inside[e]]
        return "\n\n".join(self._before(first, inside) + found) if found else None

    def _before(self, first: int, inside: list[bool]) -> list[str]:
        """Headlines and leads that stand before the first container, below its parent or the element above that: headings,
        paragraphs of 80 characters and more, and what has a class of LEAD_WORDS; without links and not marked."""
        top = self.parent[first]
        if not first or self.tag[first] in ("body", "html"):
            return []
        if self.tag[top] not in (*MAIN, "body", "html", "") and self.parent[top] > 0:
            top = self.parent[top]
        below = {top: False}  # elements there, and whether a class of theirs or above tells of a lead
        for e in range(top + 1, first):
            up = self.parent[e]
            if up in below and not self.mark[e]:
                below[e] = below[up] or not LEAD_WORDS.isdisjoint(_WORDS.findall(self.step[self.node[e]].partition(".")[2]))
        out = []
        for e, text, linked in self.blocks:
            if inside[e]:
                break
            tag = self.tag[e]
            if e in below and e != top and not linked and (below[e] or tag in ("h1", "h2") or (tag == "p" and len(text) >= 80)):
                out.append(text)
        return out


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = [Page(t.as_py() or "").best_path() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], names=["host", "path"])


def _extract(extra: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source, winner in zip(batch.column(extra), batch.column(extra + 1), strict=True):
                page = Page(source.as_py() or "")
                text = page.text(winner.as_py())
                out.append(text if text is not None else page.text(page.best_path()) or "")
            yield pa.RecordBatch.from_arrays([*batch.columns[:extra], pa.array(out, pa.string())], names=[*batch.schema.names[:extra], "text__"])

    return run


def host(url: Column) -> Column:
    """The lower-case host of a URL; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract_text(pages: DataFrame, *columns: str, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The named columns of pages and text__, the main text of the whole html.

    Each page scores its containers and votes for one generalised path; a host's path is that with the most votes
    (ties: the first by name). A page is extracted by its host's path, or by its own best where it has no such
    container. Blocks are joined by an empty line. What is marked as beside the article (see MARK_WORDS) is left out only
    below the chosen container, and not where it holds most of the page's text; where the names are weak (WEAK_WORDS) only
    if it is mostly links, or short and without a sentence. Headlines and leads that stand before the container are
    taken too (see Page._before). A page that ends within a tag or a comment ends there. Null and empty html, and pages without text, give "". Pages without
    a host vote together.
    """
    scratch = Scratch(pages.sparkSession, "html")
    hosted = pages.select(host(F.col(url_col).cast("string")).alias("host"), F.col(html_col).cast("string").alias("html"))
    votes = hosted.mapInArrow(_vote, "host string, path string").filter("path is not null").groupBy("host", "path").agg(F.count("*").alias("n"))
    best = F.min_by("path", F.struct(-F.col("n"), F.col("path")))
    winners = scratch.keep(votes.groupBy("host").agg(best.alias("winner__")).withColumnRenamed("host", "voted__"))
    chosen = pages.select(*columns, F.col(html_col).cast("string").alias("html__"), host(F.col(url_col).cast("string")).alias("host__"))
    chosen = chosen.join(winners, chosen.host__ == winners.voted__, "left").drop("host__", "voted__")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema.fields[:-2])
    return chosen.mapInArrow(_extract(len(columns)), schema + "text__ string")


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    found = extract_text(pages, "page_id", "url")
    return found.select("page_id", "url", F.col("text__").alias("text"), F.length("text__").cast("long").alias("n_chars"))
