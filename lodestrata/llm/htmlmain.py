"""Main text of web pages by consensus paths of their hosts.

Pass one scores the containers of each page (their own text less links, outside boilerplate elements) and
each page votes for its best container's generalised path of tags and classes; Spark adds the votes up by
host. Pass two re-extracts every page with its host's winning path; a page without that path uses its own.

Elements such as ``nav`` or ``form`` hold no article text, but for an article or main element within one that may wrap a
whole page. A name (``sidebar``, ``comments``) or a ``header`` only makes an element suspect: its text is left out unless the
article itself stands in it, a name of a short part holds most of a page's text that has no article element elsewhere, the
page has no other text, or it is an article's own header with a heading.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Winning paths are broadcast up to this number of hosts, else joined by a shuffle.
BROADCAST_HOSTS = 100_000
#: A container counts as holding the page's text from this share on; the deepest such container points at the article, which wins whole.
SHARE = 0.7

#: Elements without an end tag, containers, elements that end a block, and elements that hold no article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article main section div td table tbody tr center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption address hr br th thead tfoot caption details summary body html fieldset header".split())
NOT_TEXT = frozenset("head script style noscript template iframe object svg math canvas nav footer aside form button select option textarea dialog menu".split())
#: Of those, the ones that a page may put around an article, and around its main element.
AROUND_ARTICLE = frozenset("form nav".split())
AROUND_MAIN = AROUND_ARTICLE | frozenset("footer aside dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of class names and ids, and roles, of boilerplate; parts in front of a name that only says what a page has or lacks.
BAD_NAME = frozenset(
    """ad ads advert advertisement advertisements adverts banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies discussion disqus footer
    gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted recommend recommended
    related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget widgets""".split()
)
#: Of these, names of parts that are short beside an article: one that holds most of a page's text is the article under an odd name.
SHORT_NAME = frozenset("banner masthead notice notices notification pager pagination share sharing social topbar".split())
MODIFIERS = frozenset("has with no without is not show hide js".split())
BAD_ROLE = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search status toolbar".split())
#: An open element that a new one of the same row closes, up to the next container.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES |= {t: {"p"} for t in BLOCKS - VOID - set(CLOSES)} | {"hr": {"p"}}
DIGITS = re.compile(r"\d+")
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Elements that an end or an implied end doesn't reach across.
WALLS = CONTAINERS - {"tr", "tbody"} | {"ul", "ol", "table"}


def _step(tag: str, attrs: dict[str, str | None]) -> str:
    names = sorted({DIGITS.sub("#", c) for c in (attrs.get("class") or "").lower().split()})
    return ".".join([tag, *names])


def _bad(tag: str, attrs: dict[str, str | None]) -> bool:
    """Whether an element holds no article text whatever it is called."""
    if tag in NOT_TEXT or "hidden" in attrs or (attrs.get("role") or "").lower() in BAD_ROLE or (attrs.get("aria-hidden") or "") == "true":
        return True
    return "display:none" in (attrs.get("style") or "").replace(" ", "").lower()


def suspicion(tag: str, attrs: dict[str, str | None]) -> str | None:
    """The boilerplate name of an element, if it has one: the first or last part of a class or id, behind no modifier."""
    if tag in ("article", "main", "body", "html"):
        return None
    if tag == "header":
        return tag
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        parts = [x.lower() for x in PARTS.findall(name)]
        if parts and parts[0] not in MODIFIERS:
            for part in (parts[0], parts[-1]):
                if part in BAD_NAME:
                    return part
    return None


class _Page(HTMLParser):
    """Blocks of a page in order: (container path, text, characters within links, suspect elements around it)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, int | None]] = []  # tag, what it adds to ``bad`` (an article within gates takes it off), its number if it is suspect
        self.gates: list[str] = []  # tags of open boilerplate elements; others than by their tag as ""
        self.names: list[str] = []  # of all suspects by number
        self.path: list[str] = []
        self.bad = self.links = self.articles = 0
        self.suspects: list[tuple[int, str, bool]] = []  # open ones: number, name, whether an article is around it
        self.cleared: set[int] = set()
        self.seen = 0
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[tuple[tuple[str, ...], str, int, tuple[int, ...]]] = []

    def _end_block(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.blocks.append((tuple(self.path), text, self.linked, tuple(n for n, _, _ in self.suspects)))
            self.parts, self.linked = [], 0

    def _pop(self, to: int) -> None:
        while len(self.open) > to:
            tag, bad, suspect = self.open.pop()
            if tag in BLOCKS or bad or suspect is not None:
                self._end_block()
            self.bad -= bad
            if bad > 0:
                self.gates.pop()
            self.links -= tag == "a"
            self.articles -= tag in ("article", "main")
            if suspect is not None:
                self.suspects.pop()
            if tag in CONTAINERS:
                self.path.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named = dict(attrs)
        if closes := CLOSES.get(tag):
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] in closes:
                    self._pop(at)
                    break
                if self.open[at][0] in WALLS or self.open[at][1]:
                    break
        bad = _bad(tag, named)
        name = None if bad or tag in VOID else suspicion(tag, named)
        if tag in BLOCKS or bad or name:
            self._end_block()
        if tag in VOID:
            return
        if tag in ("article", "main") and not bad:
            self.cleared.update(n for n, _, _ in self.suspects)
            self.articles += 1
        elif tag in HEADINGS:
            self.cleared.update(n for n, kind, inside in self.suspects if inside and kind == "header")
        number = None
        if name:
            number, self.seen = self.seen, self.seen + 1
            self.suspects.append((number, name, self.articles > 0))
            self.names.append(name)
        weight = int(bad)
        if bad:
            self.gates.append(tag if tag in NOT_TEXT and "hidden" not in named else "")
        elif self.bad > 0 and (tag == "main" and AROUND_MAIN.issuperset(self.gates) or tag == "article" and AROUND_ARTICLE.issuperset(self.gates)):
            weight = -self.bad
        self.open.append((tag, weight, number))
        self.bad += weight
        self.links += tag == "a"
        if tag in CONTAINERS:
            self.path.append(_step(tag, named))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag not in ("script", "style"):
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._pop(at)
                return
            if self.open[at][0] in WALLS and tag not in WALLS and tag not in ("body", "html") and not self.open[at][1]:
                break
        if tag == "p":
            self._end_block()

    def handle_data(self, data: str) -> None:
        if not self.bad:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def blocks(html: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    page = _Page()
    page.feed(html or "")
    page.close()
    page._pop(0)
    page._end_block()
    sizes: dict[int, int] = {}
    for _, text, linked, around in page.blocks:
        for n in around:
            sizes[n] = sizes.get(n, 0) + max(0, len(text) - 2 * linked)
    marked = any(step.split(".", 1)[0] in ("article", "main") for path, _, _, around in page.blocks if page.cleared.issuperset(around) for step in path)
    if sizes and not marked:
        least = SHARE * sum(max(0, len(text) - 2 * linked) for _, text, linked, _ in page.blocks)
        page.cleared.update(n for n, size in sizes.items() if size > 0 and size >= least and page.names[n] in SHORT_NAME)
    free = [b for b in page.blocks if page.cleared.issuperset(b[3])]
    return [b[:3] for b in free or page.blocks]


def _article(path: tuple[str, ...]) -> tuple[str, ...] | None:
    """``path`` up to its outermost article, else main element."""
    tags = [step.split(".", 1)[0] for step in path]
    return next((path[: tags.index(t) + 1] for t in ("article", "main") if t in tags), None)


def best_path(page: list[tuple[tuple[str, ...], str, int]]) -> tuple[tuple[str, ...], int]:
    """The path of the article, and how much text outside links it holds: the article or main element around the deepest
    container with most of the page's text; without such an element, the nearest container around all blocks that aren't mostly links."""
    score: dict[tuple[str, ...], int] = {(): 0}
    for path, text, linked in page:
        own = max(0, len(text) - 2 * linked)
        for depth in range(len(path) + 1):
            score[path[:depth]] = score.get(path[:depth], 0) + own
    least = SHARE * score[()]
    path = max((p for p, s in score.items() if s >= least), key=lambda p: (len(p), score[p], p)) if score[()] else ()
    if (whole := _article(path)) is None:
        while score[path] < score[()]:
            path = path[:-1]
        whole = path
    return whole, score[whole]


def main_text(html: str | None, path: tuple[str, ...] | None) -> tuple[str, bool]:
    """Text under ``path``, else under the page's own best path; whether ``path`` was found.

    Unless ``path`` is an article or main element, text that stands directly in a container around it belongs to it too, but for blocks that are mostly links.
    """
    page = blocks(html)
    if path is not None and any(at[: len(path)] == path for at, _, _ in page):
        around = _article(path) is None
        return " ".join(text for at, text, linked in page if at[: len(path)] == path or around and at == path[: len(at)] and len(text) > 2 * linked), True
    best, _ = best_path(page)
    return " ".join(text for at, text, _ in page if at[: len(best)] == best), False


def host_paths(pages: DataFrame) -> DataFrame:
    """``(host, path, votes)`` of ``pages(host, html)``, paths as arrays of steps: each host's path with most votes (then characters, then the least path)."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best_path(blocks(x.as_py())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(p) for p, _ in found], pa.list_(pa.string())), pa.array([n for _, n in found], pa.int64())], ["host", "path", "chars"])

    votes = pages.select("host", "html").mapInArrow(vote, "host string, path array<string>, chars long").where("chars > 0")
    sums = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("chars").alias("chars"))
    return sums.groupBy("host").agg(F.min_by(F.struct("path", "votes"), F.struct(-F.col("votes"), -F.col("chars"), "path")).alias("w")).select("host", "w.path", "w.votes")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """One row per row of ``pages``: ``id_col``, ``url_col``, ``text``, ``n_chars``, ``host_path``, ``by_consensus``.

    Character references are decoded, white space becomes one space, blocks are joined by one space in page
    order. Null and empty html gives an empty text; a null or odd url has the empty host, which votes like
    any other. Repeated rows each vote and each give a row; an empty table gives an empty result.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), host.alias("host"), F.col(html_col).alias("html"))
    paths = cut(host_paths(rows))
    side = paths.select("host", "path")
    rows = rows.join(F.broadcast(side) if paths.count() <= broadcast_hosts else side, "host", "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [None if p is None else tuple(p) for p in batch.column(3).to_pylist()]
            found = [main_text(x.as_py(), p) for x, p in zip(batch.column(2), known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), batch.column(3), pa.array([c for _, c in found], pa.bool_())], ["i", "u", "text", "n_chars", "host_path", "by_consensus"])

    kinds = dict(rows.dtypes)
    out = rows.select("i", "u", "html", "path").mapInArrow(read, f"i {kinds['i']}, u {kinds['u']}, text string, n_chars long, host_path array<string>, by_consensus boolean")
    return out.select(F.col("i").alias(id_col), F.col("u").alias(url_col), "text", "n_chars", F.array_join("host_path", " > ").alias("host_path"), "by_consensus")
