"""Main text of web pages by consensus of each host's pages on where their content stands."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

# HTML element names and the class or id words of page furniture.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "select", "object", "canvas")
DROPPED = frozenset("head nav footer dialog menu".split())
DOUBTFUL = frozenset("aside form button label fieldset".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = frozenset("article main section div td body".split())
FURNITURE = frozenset(
    """ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner banners cookie cookies consent gdpr
    notice notices alert popup modal overlay newsletter subscribe subscription signup paywall nav navbar navigation menu menus
    breadcrumb breadcrumbs sidebar widget widgets header masthead footer toolbar pagination pager comment comments commentlist disqus respond reply replies
    share sharing social related recommended""".split()
)

# Last words of names like site-header that mark furniture, and first words that say what a container has or lacks.
LAST_WORDS = frozenset(
    """ad ads advert adverts advertisement banner breadcrumb breadcrumbs comments consent footer gdpr header masthead menu nav navbar navigation
    newsletter pager pagination paywall popup sidebar toolbar widget widgets""".split()
)
STATES = frozenset("has is no not with without".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
ROLES = frozenset("navigation banner contentinfo complementary alert dialog menu".split())
#: Shares of the page's text beyond which a container is no furniture after all, by how sure its mark is.
SURE, LIKELY = 0.9, 0.5


def _classes(attributes: str) -> tuple[list[str], list[str], str, bool]:
    classes, ids, role, hidden = [], [], "", False
    # One attribute after the other, so that nothing inside a quoted value counts as an attribute.
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "class":
            classes = value.split()
        elif name == "id":
            ids = value.split()
        elif name == "role":
            role = value
        elif name == "hidden":
            hidden = True
    return classes, ids, role, hidden


def _furniture(tag: str, classes: list[str], ids: list[str], role: str, hidden: bool, in_article: bool) -> float:
    """How much of the page's text an element may hold and still be furniture: 1 always, 0 never."""
    if tag in DROPPED or hidden or role in ROLES:
        return 1.0
    if tag in ("body", "html", "article", "main"):
        return 0.0
    names = [re.split(r"[-_]+", name) for name in (*classes, *ids)]
    if any(len(name) == 1 and name[0] in FURNITURE for name in names):
        return SURE
    if tag in DOUBTFUL or role in ("form", "search") or (tag == "header" and not in_article):
        return LIKELY
    if any(len(name) > 1 and name[0] not in STATES and (name[0] in FURNITURE or name[-1] in LAST_WORDS) for name in names):
        return LIKELY
    return 0.0


def _step(tag: str, classes: list[str]) -> str:
    """A path step: the tag and its classes, digits as #, so that the pages of a host share it."""
    named = sorted({re.sub(r"\d+", "#", c) for c in classes})
    return ".".join([tag, *named])


class Page:
    """A page's text blocks in order, each under its container; containers of equal path are one node.

    Scripts, markup, comments and hidden or surely dropped elements are left out while reading;
    character references are decoded and white space is one space. Elements that look like furniture
    are left out unless they hold more of the page's text than their mark allows (a form around the
    whole page, a wrapper called ``notice``). Unclosed elements end with their parent. Time is linear in
    the page, however deep its elements lie.
    """

    def __init__(self, page: str):
        # Nodes are numbered after their parents; node 0 is above all containers.
        self.parent, self.step, self.number = [0], [""], {}
        self.blocks: list[tuple[int, str, int]] = []
        marks: list[tuple[int, float]] = [(-1, 0.0)]  # of each doubtful element: the one around it, its allowance
        found = self._read(page, marks)
        held = [0] * len(marks)
        for _, text, _, mark in found:
            held[mark] += len(text)
        for k in range(len(marks) - 1, 0, -1):
            held[marks[k][0]] += held[k]
        gone = [False] * len(marks)
        for k in range(1, len(marks)):
            gone[k] = gone[marks[k][0]] or held[k] <= marks[k][1] * held[0]
        self.blocks = [(node, text, linked) for node, text, linked, mark in found if not gone[mark]]

    def _read(self, page: str, marks: list[tuple[int, float]]) -> list[tuple[int, str, int, int]]:
        out: list[tuple[int, str, int, int]] = []
        stack: list[tuple[str, int, bool, int, bool]] = [("", 0, False, 0, False)]  # tag, node, dropped, mark, in an article
        opened: dict[str, int] = {}
        text: list[str] = []
        linked, in_link, at = 0, 0, 0

        def flush() -> None:
            nonlocal linked
            got = " ".join(html.unescape("".join(text)).split())
            if got:
                out.append((stack[-1][1], got, linked, stack[-1][3]))
            text.clear()
            linked = 0

        def say(part: str) -> None:
            nonlocal linked
            if part and not stack[-1][2]:
                text.append(part)
                if in_link:
                    linked += len(part)

        def pop() -> str:
            tag = stack.pop()[0]
            opened[tag] -= 1
            return tag

        while found := TOKEN.search(page, at):
            say(page[at : found.start()])
            at = found.end()
            tag = (found[2] or "").lower()
            if not tag:
                continue
            if found[1]:
                if tag == "a":
                    in_link = 0
                if tag in INLINE:
                    continue
                flush()
                if opened.get(tag):
                    while pop() != tag:
                        pass
                continue
            if tag in RAW:
                if not found[3].rstrip().endswith("/"):
                    end = RAW_END[tag].search(page, at)
                    at = end.end() if end else len(page)
                continue
            if tag in INLINE:
                in_link = 1 if tag == "a" else in_link
                continue
            flush()
            in_link = 0 if tag != "br" else in_link
            if tag in VOID:
                continue
            while stack[-1][0] in CLOSES.get(tag, ()):
                pop()
            classes, ids, role, hidden = _classes(found[3]) if found[3] else ([], [], "", False)
            _, node, gone, mark, within = stack[-1]
            if not gone:
                allowed = _furniture(tag, classes, ids, role, hidden, within)
                gone = allowed == 1.0
                if 0.0 < allowed < 1.0:
                    marks.append((mark, allowed))
                    mark = len(marks) - 1
            if tag in CONTAINERS:
                node = self._node(node, _step(tag, classes))
            stack.append((tag, node, gone, mark, within or tag in ("article", "main")))
            opened[tag] = opened.get(tag, 0) + 1
        say(page[at:])
        flush()
        return out

    def _node(self, parent: int, step: str) -> int:
        node = self.number.get((parent, step))
        if node is None:
            node = self.number[parent, step] = len(self.parent)
            self.parent.append(parent)
            self.step.append(step)
        return node

    def path(self, node: int) -> str:
        steps = []
        while node:
            steps.append(self.step[node])
            node = self.parent[node]
        return "".join(f"/{x}" for x in reversed(steps))

    def best(self) -> tuple[str, float]:
        """The path that scores highest: text outside links below it, less what its ancestors add as noise.

        Each container gets its own blocks' text in full and each level up only nine tenths of it, so a
        parent wins only if it holds clearly more text; ``article`` and ``main`` count for a quarter more.
        Ties go to the longer path, then to the container that comes later in the page. No blocks in a container: an empty path, score 0.
        """
        weight, met = [0.0] * len(self.parent), [False] * len(self.parent)
        for node, text, linked in self.blocks:
            weight[node] += max(0.0, len(text) - 2.0 * linked)
            met[node] = True
        for node in range(len(self.parent) - 1, 0, -1):
            weight[self.parent[node]] += 0.9 * weight[node]
            met[self.parent[node]] |= met[node]
        scores = [w * (1.25 if step.split(".")[0] in ("article", "main") else 1.0) for w, step in zip(weight, self.step)]
        held = [k for k in range(1, len(scores)) if met[k]]
        if not held:
            return "", 0.0
        size = [0] * len(scores)
        for node in range(1, len(scores)):
            size[node] = size[self.parent[node]] + 1 + len(self.step[node])
        won = max(held, key=lambda k: (scores[k], size[k], k))
        return self.path(won), scores[won]

    def below(self, path: str) -> str:
        """The blocks at or below ``path``, joined by one space."""
        target = 0
        for step in path.split("/")[1:]:
            target = self.number.get((target, step), -1)
            if target < 0:
                return ""
        inside = [k == target for k in range(len(self.parent))]
        for k in range(1, len(self.parent)):
            inside[k] |= inside[self.parent[k]]
        return " ".join(text for node, text, _ in self.blocks if inside[node])

    def text(self, path: str | None) -> tuple[str, str]:
        """The main text and the path it was taken from: the host's ``path``, or the page's own best container
        where that has more than ``OWN`` times the text; all blocks where there is no container."""
        own = self.best()[0]
        mine = self.below(own) if own else " ".join(text for _, text, _ in self.blocks)
        got = self.below(path) if path else ""
        return (got, path) if path and got and len(mine) <= OWN * len(got) else (mine, own)


#: A host's winning path gives way to the page's own best container if that holds so many times its text:
#: the path may lead to a teaser on a page whose article stands elsewhere.
OWN = 2


def host_of(url) -> F.Column:
    """The url's host in lower case without a leading ``www.``; empty if there is none."""
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit(""))), r"^www\.", "")


def host_paths(pages: DataFrame) -> DataFrame:
    """``(host, path)``: the container path that most text of a host's pages votes for, ties by name."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [Page(h or "").best() for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([p for p, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["host", "path", "score"]
            )

    votes = (
        pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(vote, "host string, path string, score double")
        .where("path <> ''").groupBy("host", "path").agg(F.count("*").alias("votes"), F.round(F.sum("score"), 3).alias("score"))
    )
    first = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("score"), "path"))
    return votes.withColumn("_n", first).where("_n = 1").select("host", "path")


#: Winning paths are sent to every task up to so many bytes; more of them are joined by shuffled, salted hosts.
SENT_BYTES = 32 << 20


def extract_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars, path)`` for every row of ``pages(page_id, url, html)``.

    Text is that below the host's winning path; a page without it, or whose own best container holds
    more than ``OWN`` times its text, uses that container, and one with no container all its blocks.
    Null html gives an empty text, ties between paths go by votes, score and name, other columns are ignored.
    Repeated rows stay; a null url has the empty host.
    """
    from noticelake.llm.common import cut

    winners = cut(host_paths(pages))
    size = winners.agg(F.count("*"), F.sum(F.length("host") + F.length("path") + 64)).first()
    inner = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    if (size[1] or 0) <= SENT_BYTES:
        joined = inner.join(F.broadcast(winners), "host", "left")
    else:
        salts = pages.sparkSession.sparkContext.defaultParallelism
        joined = inner.withColumn("_s", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts))).join(
            winners.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["host", "_s"], "left"
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, used = [], []
            for page, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                got, path = Page(page or "").text(path)
                done.append(got)
                used.append(path or "")
            new = [pa.array(done, pa.string()), pa.array([len(t) for t in done], pa.int64()), pa.array(used, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *new], ["page_id", "url", "text", "n_chars", "path"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "path").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long, path string"
    )
