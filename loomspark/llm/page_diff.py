"""HTML extraction by nearest-url page differencing, checked against what pages mark as their article.

A page is cut into blocks of text, its lines. Blocks in navigation, headers, footers, sidebars,
forms, adverts, notices, comments and the like, by element, role or class, go. Every page is
paired with its neighbours by url path on the same host, pages with the same lines passed over
(those that mark an article with others that do, the rest with the rest): lines are aligned by
their longest common subsequence, and lines shared with both are the site's template, which is
deleted. At an end of the host, the two nearest on one side decide.

A check follows on pages that mark their article (``article`` or ``main``): what differencing
deleted inside the mark comes back, what it left outside goes. In the pages at hand, menus,
adverts and footers differ from page to page and so survive differencing, while an article that
two neighbours share would be deleted (see README). ``n_template`` and ``n_restored`` tell what
differencing deleted from a page and what of it the check brought back.

At scale: pages are parsed where they are read, twice: for their keys, which are stored, and for
their lines, which are not, since that would take as much disk as they do. Lines move once, dealt in blocks of
consecutive (mark or none, host, path), each block with the page before and after it; a hot
host is cut like any other stretch of urls. Where copies reach over a block and the page beside
it, or a block at an end of the host holds one page, fewer neighbours decide than there are; a
page for which none is known keeps its lines.

Defined results: null html has no text; a page alone on its host among those of its kind has
no partner and keeps its lines; unclosed elements end with their parent; undecodable
references stay as they are; repeated rows are extracted each; extra columns are
ignored. Null ids, urls and texts are dealt like others: rows alike in url and id are ordered
by a hash of their lines, so that they make no block of their own.
"""

from __future__ import annotations

import html as entities
import os.path
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.ordered import beside
from loomspark.llm.tables import stored
from loomspark.llm.url_filter import url_parts
from loomspark.llm.words import slices

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are no article text.
DROPPED = frozenset("head title nav header footer aside form menu dialog button select option datalist noscript object canvas audio video map".split())
MARKED = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Class names and ids of what is no article text.
NAMES = re.compile(
    r"(?:site|page|main|top|bottom|left|right|global|user|reader|primary|secondary|cookie|post|social|related|js)?[-_]?"
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|header|footer|masthead|sidebar|aside|cookies?|consent|gdpr|"
    r"notices?|notification|alert|newsletter|subscri\w+|signup|login|popup|modal|overlay|paywall|shar(?:e|ing)|social|related|recommended|recommendations|"
    r"comments?|replies|disqus|widget|searchbox|search|toolbar|pagination|pager|copyright)"
    r"(?:[-_](?:box|bar|block|area|list|section|container|wrapper|inner|content|slot|unit|form|links?|top|bottom|left|right|\d+))*"
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|textarea|iframe|svg|math|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[a-zA-Z/!?][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)


@dataclass
class Page:
    """A page's blocks that no region drops, in order, and which of them are in a marked article."""

    lines: list[str]
    inside: list[bool]

    @property
    def marked(self) -> list[str]:
        return [line for line, inside in zip(self.lines, self.inside, strict=True) if inside]

    @property
    def open(self) -> list[str]:
        return [line for line, inside in zip(self.lines, self.inside, strict=True) if not inside]


def dropped(tag: str, attributes: str) -> bool:
    """Whether an element is no part of the article."""
    if tag in DROPPED:
        return True
    if tag in MARKED or tag in ("html", "body") or not attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        names = (m[2] or m[3] or m[4] or "").lower().split()
        if any(n in ROLES for n in names) if m[1].lower() == "role" else any(NAMES.fullmatch(n) for n in names):
            return True
    return False


def blocks(source: str) -> Page:
    """The blocks of a page in order, references decoded and white space made single spaces."""
    page, text = Page([], []), []
    stack: list[tuple[str, bool, bool]] = []  # element, dropped, marked: each also holds for what it contains
    at, state = 0, (False, False)

    def ended() -> None:
        if text:
            if not state[0] and (line := " ".join(entities.unescape("".join(text)).split())):
                page.lines.append(line)
                page.inside.append(state[1])
            text.clear()

    for m in TOKEN.finditer(source):
        if m.start() > at:
            text.append(source[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag == "br":
            text.append(" ")
        if tag not in INLINE:
            ended()
        if m[2]:
            if any(tag == x[0] for x in reversed(stack)):
                while True:
                    closed = stack.pop()
                    if closed[1:] != (stack[-1][1:] if stack else (False, False)):
                        ended()
                        state = stack[-1][1:] if stack else (False, False)
                    if closed[0] == tag:
                        break
        elif tag not in VOID and not (m[4] or "").endswith("/"):
            inside = (state[0] or dropped(tag, m[4] or ""), state[1] or tag in MARKED)
            if inside != state:
                ended()
                state = inside
            if tag not in ("p", "li") or not stack or stack[-1][0] != tag:  # they end at the next one
                stack.append((tag, *inside))
    text.append(source[at:])
    ended()
    return page


def prefix_lengths(a: list[str], b: list[str]) -> tuple[list[int], int]:
    """Bit-parallel common subsequence: after each line of ``a``, a number whose zero bits mark where lengths grow along ``b``."""
    places: dict[str, int] = {}
    for k, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << k
    full = (1 << len(b)) - 1
    rows, v = [], full
    for line in a:
        u = v & places.get(line, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows, full


def shared_lines(a: list[str], b: list[str], limit: int = 1 << 30) -> list[int]:
    """Places in ``a`` of the lines of a longest common subsequence with ``b``."""
    start = len(os.path.commonprefix([a, b]))
    stop = len(os.path.commonprefix([a[start:][::-1], b[start:][::-1]]))
    head, tail = list(range(start)), list(range(len(a) - stop, len(a)))
    a, b = a[start : len(a) - stop], b[start : len(b) - stop]
    if not a or not b:
        return head + tail
    if len(a) * len(b) > limit and len(a) > 1:  # halve ``a``, and cut ``b`` where both halves' lengths add up to most
        half = len(a) // 2
        growth = lambda x, y: [0, *accumulated(prefix_lengths(x, y)[0][-1], len(y))]
        fore, back = growth(a[:half], b), growth(a[half:][::-1], b[::-1])
        cut = max(range(len(b) + 1), key=lambda j: fore[j] + back[len(b) - j])
        middle = [*shared_lines(a[:half], b[:cut], limit), *(half + k for k in shared_lines(a[half:], b[cut:], limit))]
    else:
        rows, full = prefix_lengths(a, b)
        middle, j = [], len(b) - 1
        for i in range(len(a) - 1, -1, -1):
            grown = ~rows[i] & full & ((2 << j) - 1)
            if not grown:
                break
            j = grown.bit_length() - 1
            if i == 0 or rows[i - 1] >> j & 1:  # the length grows at j only from this line on
                middle.append(i)
                j -= 1
                if j < 0:
                    break
        middle.reverse()
    return head + [start + k for k in middle] + tail


def accumulated(row: int, size: int) -> list[int]:
    out, n = [], 0
    for k in range(size):
        n += not row >> k & 1
        out.append(n)
    return out


def template_lines(lines: list[str], others: list[list[str]]) -> set[int]:
    """Places of ``lines`` that are shared with each of ``others``."""
    shared = [set(shared_lines(lines, x)) for x in others]
    return set.intersection(*shared) if shared else set()


def checked(inside: list[bool], template: set[int]) -> tuple[list[int], int]:
    """Places of the lines that stay, and how many of the template's came back: a marked article is whole, and all there is."""
    if not any(inside):
        return [k for k in range(len(inside)) if k not in template], 0
    return [k for k, x in enumerate(inside) if x], sum(inside[k] for k in template)


@dataclass
class Run:
    """Consecutive pages of a host with the same lines: id, url, which lines are in a marked article, and whether the row is the block's own."""

    host: tuple[bool, str]
    lines: list[str]
    rows: list[tuple[int | None, str | None, list[bool], bool]]


def others_of(runs: list[Run], k: int) -> list[list[str]]:
    """The nearest pages with other lines on both sides; at an end of the host, the nearest two of one side."""

    def side(step: int) -> list[list[str]]:
        out, at = [], k + step
        while len(out) < 2 and 0 <= at < len(runs) and runs[at].host == runs[k].host:
            if runs[at].lines != runs[k].lines:
                out.append(runs[at].lines)
            at += step
        return out

    before, after = side(-1), side(1)
    return [before[0], after[0]] if before and after else before or after


def parsed(pages: DataFrame) -> DataFrame:
    """``page_id, url, lines, inside`` of every row: its lines, and which of them are in a marked article."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            found = [blocks(source or "") for source in batch.column("html").to_pylist()]
            columns = [batch.column("page_id"), batch.column("url"), pa.array([p.lines for p in found], pa.list_(pa.string())), pa.array([p.inside for p in found], pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "lines", "inside"])

    narrow = pages.selectExpr("cast(page_id AS bigint) AS page_id", "cast(url AS string) AS url", "cast(html AS string) AS html")
    return narrow.mapInArrow(cut, "page_id long, url string, lines array<string>, inside array<boolean>")


RESULT = {"page_id": pa.int64(), "url": pa.string(), "text": pa.string(), "n_lines": pa.int64(), "n_template": pa.int64(), "n_restored": pa.int64()}


def differenced(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """``page_id, url, text, n_lines, n_template, n_restored`` of ``pages`` (those of ``parsed``): what their nearest pages have too is deleted, then checked."""
    host, path = url_parts(F.col("url"))
    narrow = pages.withColumns({"marked": F.array_contains("inside", True), "host": host, "path": path})
    number = F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, "0")
    key = F.concat_ws("\0", F.col("marked").cast("string"), "host", "path", number, F.hex(F.xxhash64("lines")))
    keys = stored(narrow.select(key.alias("key")), "keys")
    placed = beside(narrow, key, parts, keys=keys).sortWithinPartitions("_block", "_halo", "_key", "lines")

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, runs, out = None, [], []

        def results() -> None:
            for k, run in enumerate(runs):
                if any(own for *_, own in run.rows):
                    template = template_lines(run.lines, others_of(runs, k))
                    for page_id, url, inside, own in run.rows:
                        if own:
                            kept, restored = checked(inside, template)
                            out.append((page_id, url, "\n".join([run.lines[i] for i in kept]), len(inside), len(template), restored))
            runs.clear()

        def written() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * len(RESULT)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, RESULT.values(), strict=True)], names=list(RESULT))
            out.clear()
            return batch

        for batch in slices(batches, 512):
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "marked", "host", "lines", "inside", "_block", "_halo"))
            for page_id, url, marked, name, lines, inside, own, halo in zip(*columns, strict=True):
                if own != block:
                    results()
                    block = own
                if not runs or runs[-1].host != (marked, name) or runs[-1].lines != lines:
                    runs.append(Run((marked, name), lines, []))
                runs[-1].rows.append((page_id, url, inside, halo == 0))
            yield written()
        results()
        yield written()

    return placed.mapInArrow(walked, "page_id long, url string, text string, n_lines long, n_template long, n_restored long")


def extract(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """``page_id, url, text, n_chars, n_lines, n_template, n_restored`` of every row of ``pages`` (``page_id``, ``url``, ``html``)."""
    text = differenced(parsed(pages), parts)
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_template", "n_restored")
