"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import bisect
import html
import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import prepare

#: Attributes of a tag: quoted values may hold anything; where a quote has no end, the tag ends at the next ">".
_ATTRS = r"(?:(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+(?=>)|[^>]*)"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|title)(?![a-zA-Z0-9-])" + _ATTRS + r">.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9-]*)(?P<attrs>" + _ATTRS + r")>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

#: Elements that begin a line of their own.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold the article.
ASIDE = frozenset("nav footer aside form button select dialog menu head object canvas audio video".split())
#: Words of a class, id or role that name what is not the article; a name is one of these alone, or with ``FILLER`` words only.
ASIDE_WORD = re.compile(
    r"ads?|advert\w*|banner\w*|promo\w*|sponsor\w*|nav\w*|menu\w*|sidebar\w*|footer\w*|cookie\w*|consent\w*|gdpr|notice\w*|notif\w*|alert\w*"
    r"|popup\w*|modal\w*|overlay\w*|newsletter\w*|subscri\w*|share\w*|sharing|social\w*|comment\w*|repl(?:y|ies)\w*|discuss\w*|respond\w*|related\w*"
    r"|recommend\w*|breadcrumb\w*|paginat\w*|pager|widget\w*|toolbar\w*|login|signup|search\w*|masthead|copyright|legal|disclaimer\w*|skip\w*"
    r"|complementary|contentinfo|dialog|form",
    re.I,
)
FILLER = re.compile(
    r"|\d+|area|articles?|bar|bottom|box(?:es)?|buttons?|col|column|container|global|group|header|holder|icons?|inner|items?|left|links?|list|main|outer|page|panel|posts?|primary"
    r"|readers?|right|row|secondary|sections?|site|slot|stories|text|title|top|unit|users?|wrap|wrapper|you|up",
    re.I,
)
#: A page's own header, which unlike an article's has no other word before it.
HEADER_WORD = re.compile(r"(?:^|\s)(?:(?:site|page|top|global|main)[-_]?)?(?:header|topbar|top-bar)(?:$|\s)", re.I)
#: Elements whose end tag may be missing: another of their kind, or the end of what holds them, ends them.
OPEN_ENDED = frozenset("li p dt dd td th tr option".split())
#: Adverts and their like, which may stand amid the text and part nothing.
ADVERT_WORD = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner\w*|promo\w*|sponsor\w*|newsletter\w*|subscri\w*|share\w*|sharing|social\w*)(?:$|[\s_-])", re.I)
#: Whole ids and classes of blocks that name what is not the article where they stand in one.
ASIDE_NAME = re.compile(
    r"(?:^|\s)(?:ads?|advert\w*|banner|promo|sponsored|nav|navigation|menu|sidebar|footer|cookies?|newsletter|share|social"
    r"|(?:reader-|user-|post-)?comments?(?:-(?:list|section|area))?|replies|respond|related(?:-(?:posts|articles|stories|links))?|recommended|breadcrumbs?|pagination|login|signup)(?:$|\s)",
    re.I,
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Starts of these end an open paragraph.
PARAGRAPH_ENDS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
MARKED = ("article", "main")
#: Lines of a window; most characters that count of a line; what a line in an article or main element counts beside them.
WINDOW, LINE, MARK = 3, 200, 800
#: A region surges at this share of the page's greatest window, and needs this share of the largest region's text, in which marked text counts fourfold.
SHARE, MARK_TIMES = 0.25, 4


#: Elements that hold blocks: what is taken out between two lines of one of them does not part them.
HOLDERS = frozenset("body div section td main article".split())


class Line(NamedTuple):
    """A line that stripped markup leaves: characters outside links, the outermost main and article elements it stands in (0: none), whether something was taken out before it, and its innermost holder."""

    text: str
    plain: int
    main: int
    article: int
    gap: bool
    holder: int

    @property
    def mark(self) -> bool:
        return bool(self.main or self.article)


def names_aside(name: str) -> bool:
    """Whether a class, id or role says that its element is not of the article: parts that are aside words, and else fillers only ("has-sidebar" has another)."""
    parts = re.split(r"[-_]+", name)
    words = [p for p in parts if ASIDE_WORD.fullmatch(p)]
    return bool(words) and all(p in words or FILLER.fullmatch(p) for p in parts)


def _aside(name: str, attrs: str, inside: bool) -> str:
    """"advert" or "other" if the element is not of the article, else nothing; ``inside``: it stands in an article or main element.

    Names count on blocks only: an inline element stands amid a sentence.
    """
    if name in ASIDE or name == "header" and not inside:
        return "other"
    if not attrs or name not in BLOCKS or name in HEADINGS and inside or name in ("html", "body", *MARKED) and "comment" not in attrs.lower():
        return ""
    for _, a, b, c in ATTRIBUTE.findall(attrs):
        value = a or b or c
        if ASIDE_NAME.search(value) if inside else any(map(names_aside, value.split())) or HEADER_WORD.search(value):
            return "advert" if ADVERT_WORD.search(value) else "other"
    return ""


def element_ends(tokens: list[re.Match]) -> list[tuple[int, int]]:
    """For each token that starts an element, the token and the place in the page that follow the element.

    An end tag ends the innermost open element of its name and all within it. An element that ends
    only so although its kind needs an end tag of its own may have lost it to an element within: it ends
    before the first article or main element in it, or else after the last end tag of its kind in
    it, or else before the next block.
    """
    ends = [(i + 1, m.end()) for i, m in enumerate(tokens)]
    names = [(m["name"] or "").lower() for m in tokens]
    closes: dict[str, list[int]] = defaultdict(list)
    blocks, marked, amiss = [], [], []
    count: Counter[str] = Counter()
    stack: list[int] = []

    def end(i: int) -> int:
        at = stack.pop()
        count[names[at]] -= 1
        ends[at] = (i, tokens[i].start()) if i < len(tokens) else (i, tokens[-1].endpos)
        return at

    def implied(i: int) -> None:
        at = end(i)
        if names[at] not in OPEN_ENDED and names[at] not in ("html", "body", *MARKED):
            amiss.append(at)

    for i, m in enumerate(tokens):
        name = names[i]
        if name in BLOCKS:
            blocks.append(i)
        if not name or name in VOID:
            continue
        if m["close"]:
            closes[name].append(i)
            if count[name]:
                while names[stack[-1]] != name:
                    implied(i)
                ends[end(i)] = (i + 1, m.end())
            continue
        if name in MARKED:
            marked.append(i)
        while stack and (names[stack[-1]] == name and name in OPEN_ENDED or names[stack[-1]] == "p" and name in PARAGRAPH_ENDS):
            end(i)
        if not m["attrs"].endswith("/"):
            stack.append(i)
            count[name] += 1
    while stack:
        implied(len(tokens))
    for at in amiss:
        first = lambda of, at=at: next(iter(of[bisect.bisect_right(of, at) :][:1]), len(tokens))
        own = closes[names[at]]
        last = own[k - 1] if (k := bisect.bisect_left(own, ends[at][0])) and own[k - 1] > at else -1
        before = first(marked)
        if before >= min(ends[at][0], last if last > 0 else ends[at][0]):
            if last > 0:
                ends[at] = (last + 1, tokens[last].end())
                continue
            before = first(blocks)
        if before < ends[at][0]:
            ends[at] = (before, tokens[before].start())
    return ends


def page_lines(page: str) -> list[Line]:
    """The lines of a page, without the elements that are not of the article and all that they hold.

    Adverts and their like leave no gap, nor does what is taken out of an article or main element, or
    between two lines that the same element holds.
    """
    lines: list[Line] = []
    parts: list[str] = []
    plain = link = 0
    gap = False
    marks: list[tuple[str, int]] = []
    holders: list[tuple[int, int]] = []
    tokens = list(TOKEN.finditer(page))
    ends = element_ends(tokens)

    def flush() -> None:
        nonlocal plain, gap
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            lines.append(Line(text, plain, *(next((k for name, k in marks if name == x), 0) for x in ("main", "article")), gap, holders[-1][1] if holders else 0))
            gap = False
        plain = 0

    def add(text: str) -> None:
        nonlocal plain
        if text:
            parts.append(text)
            if not link:
                plain += len(text.strip())

    i = at = 0
    while i < len(tokens):
        m = tokens[i]
        add(page[at : m.start()])
        at = m.end()
        i += 1
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in BLOCKS or name in ASIDE:
            flush()
        while holders and holders[-1][0] <= i:
            holders.pop()
        if m["close"]:
            if name in MARKED and any(x == name for x, _ in marks):
                while marks.pop()[0] != name:
                    pass
            link = 0 if name == "a" else link
            continue
        kind = "" if name in VOID or m["attrs"].endswith("/") else _aside(name, m["attrs"], bool(marks))
        if kind:
            flush()
            gap = gap or kind == "other" and not marks
            i, at = ends[i - 1]
            continue
        if name in HOLDERS and not m["attrs"].endswith("/"):
            holders.append((ends[i - 1][0], i))
        if name in MARKED:
            marks.append((name, i))
        elif name == "a":
            link = 1
    add(page[at:])
    flush()
    return lines


def window_regions(weight: list[int], window: int, share: float) -> list[tuple[int, int]]:
    """First and last place of each region that surges.

    Weights are summed over windows of ``window`` places. A region dives where a sum falls to zero; it
    surges if a window of it reaches ``share`` of the greatest. It runs from its first place with a
    weight to its last.
    """
    sums = [0]
    for w in weight:
        sums.append(sums[-1] + w)
    window_at = [sums[min(i + window, len(weight))] - sums[i] for i in range(len(weight))]
    peak = max(window_at, default=0)
    regions: list[tuple[int, int]] = []
    begun, surged = -1, False
    for i, s in enumerate([*window_at, 0]):
        if s and begun < 0:
            begun, surged = i, False
        surged = surged or s > 0 and s >= share * peak
        if not s and begun >= 0:
            held = [k for k in range(begun, i) if weight[k]]
            if surged:
                regions.append((held[0], held[-1]))
            begun = -1
    return regions


def main_text(page: str | None) -> str:
    """The article's lines, joined by a line feed.

    A line weighs its characters, ``LINE`` at most, and nothing if most of them are links; one in an
    article or main element weighs ``MARK`` more. ``WINDOW`` places without weight stand for what was
    taken out between lines of different holders and for the borders of articles. The regions between the places where
    windows of weights surge and dive are kept, with all their lines, if they have ``SHARE`` of the largest
    region's text.
    """
    lines = page_lines(page or "")
    weight: list[int] = []
    place: list[int] = []
    article = 0
    for before, line in itertools.pairwise([None, *lines]):
        if before and (line.gap and before.holder != line.holder or before.mark != line.mark or line.article and article not in (0, line.article)):
            weight += [0] * WINDOW
        article = line.article or article
        place.append(len(weight))
        links = line.plain * 3 < len(line.text)
        weight.append(MARK + min(line.plain, LINE) if line.mark else 0 if links else max(1, min(line.plain, LINE)))
    regions = window_regions(weight, WINDOW, SHARE)
    held = [[x for x, p in zip(lines, place, strict=True) if a <= p <= b] for a, b in regions]
    mass = [sum((MARK_TIMES if x.mark else 1) * max(1, x.plain) for x in some) for some in held]
    return "\n".join(x.text for some, w in zip(held, mass, strict=True) if w >= SHARE * max(mass) for x in some)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``id_col, url_col, text, n_chars`` (code points).

    Null and empty pages, and pages without text of their own, give the empty string. Each line is one
    block of the page, its character references decoded and white space made single. Whole pages of any
    length are read, once, in time that grows with their length; nothing is shuffled. Repeated rows stay;
    other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t.as_py()) for t in b.column(2)]
            size = pa.array([len(t) for t in texts], pa.int64())
            texts = [t.encode("utf-8", "replace").decode() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), size], ["id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    out = rows.mapInArrow(run, f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars bigint")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
