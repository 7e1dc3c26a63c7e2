"""Main text of web pages by tag-path ratios.

A page is read into blocks: runs of text between block-level tags, with inline markup
melted in. The path of a block is the block-level tags and classes from the root to
it. For each path the length of its texts and their punctuation are summed over the
page's blocks; the ratios of both to the number of blocks are smoothed over the
blocks in page order and multiplied. Paths whose score passes a threshold are
content, on every page. Marks of the page are priors: text that passes counts double
inside an article or main element, and that element is the main text as long as it
then has the greater part. A name like "related" speaks against a subtree unless its
paths pass with long, punctuated text of few links. Elements for menus, forms and so
on, adverts, comments and consent texts never are content: their ratios look like it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of the HTML standard.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr img br picture source audio video map area".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
SAME_LEVEL = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}} | dict.fromkeys(("tr", "td", "th", "thead", "tbody"), {"table"})
#: Elements that hold no main text.
OTHER_TAGS = frozenset(
    "head nav footer aside form button select option menu dialog search input fieldset datalist output progress meter".split()
)
#: Words in class, id or role that name something other than the main text.
OTHER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner banners "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside complementary widget widgets "
    "header masthead topbar footer footers bottom contentinfo "
    "comment comments commentlist disqus reply replies respond discussion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay toast newsletter subscribe subscription signup "
    "share sharing social related recommended recommendations pagination pager search login form toolbar hidden".split()
)
#: Of these, names of running text by others; its ratios cannot tell it from the main text.
FIRM_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted comment comments commentlist "
    "disqus cookie cookies consent gdpr newsletter subscribe hidden".split()
)
#: Words that also name a part of the author's own text, when they stand on a section inside the content.
PART_NAMES = frozenset("discussion notice notices related social form search".split())
#: Last words of a name that leave its meaning to the first one ("share-buttons").
SHELL_NAMES = frozenset(
    "area bar block box button buttons container content group holder icon icons inner items link links list outer panel post posts "
    "row section slot unit wrap wrapper".split()
)
#: A name with one of these speaks of the layout around it ("has-sidebar").
LAYOUT_NAMES = frozenset("has with without no".split())
HEADINGS = frozenset(f"h{n}" for n in range(1, 7))
#: A path's fused score must reach this share of the mean over the page's blocks, weighted by length.
THRESHOLD = 0.2
#: Text inside an article or main element counts this many times.
INSIDE = 2
#: Characters outside links, and marks of punctuation among them, of a long text.
LONG, MARKS = 200, 3
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
NAMED = ("class", "id", "role", "aria-label")
_WORD = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")


@dataclass
class Block:
    """Text between two block-level tags."""

    path: int  # number of the path of block-level tags from the root
    text: str
    linked: int  # characters inside links
    level: int  # 2 inside an article, 1 inside main, 0 elsewhere
    doubt: int = 0  # number of the outermost element around it whose name speaks against it
    heading: bool = False


def _attributes(text: str) -> dict[str, str]:
    """Names, in lower case, and values; the first of equal names counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _named(name: str) -> str | None:
    """The word of OTHER_NAMES that a name is, ends with or wraps."""
    parts = _WORD.findall(name)
    if not parts or not LAYOUT_NAMES.isdisjoint(parts):
        return None
    if parts[-1] in OTHER_NAMES:
        return parts[-1]
    shell = len(parts) > 1 and all(x in SHELL_NAMES for x in parts[1:])
    return parts[0] if shell and parts[0] in OTHER_NAMES else None


def _other(tag: str, attributes: dict[str, str], level: int) -> tuple[bool, bool]:
    """Does this element hold something other than the main text: surely, or by its name?"""
    if tag in OTHER_TAGS or (tag == "header" and level < 2):
        return True, False
    if not attributes:
        return False, False
    hidden = "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true"
    if hidden or _NO_DISPLAY.search(attributes.get("style", "")):
        return True, False
    if tag in ("html", "body", "main") or tag in HEADINGS:
        return False, False
    doubt = False
    for kind in NAMED:
        value = attributes.get(kind, "").lower()
        part = level and tag == "section"
        if not value or (part and kind in ("id", "aria-label")):
            continue  # the title of a part of the content
        for name in [value] if kind == "aria-label" else value.split():
            word = " ".join(value.split()) if kind == "aria-label" else _named(name)
            if word not in OTHER_NAMES or (word == "header" and (level or name != word)):
                continue  # a header inside the content, or of an entry, holds its title
            if part and name in PART_NAMES:
                continue
            if word in FIRM_NAMES:
                return True, False
            doubt = True
    return False, doubt


class _Open:
    """An open element."""

    __slots__ = ("tag", "other", "path", "doubt", "level")

    def __init__(self, tag: str, other: bool, path: int, doubt: int, level: int) -> None:
        self.tag, self.other, self.path, self.doubt, self.level = tag, other, path, doubt, level


def blocks(page: str) -> tuple[list[Block], int]:
    """All blocks of text outside of elements that hold none of the main text.

    And the highest level that the page has: 2 with an article, 1 with main, else 0.
    """
    out: list[Block] = []
    stack = [_Open("", False, 0, 0, 0)]  # the page itself
    places: dict[str, list[int]] = {}  # where elements of a tag stand in the stack
    walls = [0]  # where block-level elements stand
    paths: dict[tuple[int, str], int] = {}
    text: list[str] = []
    linked = at = highest = others = links = doubts = 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                here, wall = stack[-1], stack[walls[-1]]
                out.append(Block(here.path, whole, min(linked, len(whole)), here.level, here.doubt, wall.tag in HEADINGS))
            text.clear()
        linked = 0

    def pop(count: int) -> None:
        nonlocal others, links
        for _ in range(count):
            gone = stack.pop()
            places[gone.tag].pop()
            if walls[-1] == len(stack):
                walls.pop()
            others -= gone.other
            links -= gone.tag == "a"

    def innermost(tags: set[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags: set[str], scope: set[str]) -> None:
        """Close the innermost of ``tags``, unless an element of ``scope`` lies above it."""
        n = innermost(tags)
        if n and n > innermost(scope - tags):
            flush()
            pop(len(stack) - n)

    def add(chunk: str) -> None:
        nonlocal linked
        if not others and chunk:
            text.append(chunk)
            if links:
                linked += len(chunk.strip())

    position = 0
    while (found := _TAG.search(page, position)) is not None:
        add(page[at : found.start()])
        at = position = found.end()
        if not found[2]:
            if found[0].startswith("<![CDATA["):
                add(found[0][9:].removesuffix("]]>"))
            continue
        tag = found[2].lower()
        if found[1]:
            n = innermost({tag})
            if n and not (tag in INLINE and walls[-1] > n):  # an inline end tag does not close blocks
                if tag not in INLINE:
                    flush()
                pop(len(stack) - n)
            continue
        if tag in RAW:
            if tag in INLINE or not found[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = position = end.end() if end else len(page)
            add(" ")
            continue
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P:
                close({"p"}, {"td", "th", "button", "table", "article", "main"})
            if tag in SAME_LEVEL:
                for _ in range(3):
                    close(SAME_LEVEL[tag], SCOPE.get(tag, set()))
                    if stack[-1].tag not in SAME_LEVEL[tag]:
                        break
        elif tag in ("br", "img"):
            add(" ")
        if tag in VOID:
            continue
        around = stack[-1]
        attributes = _attributes(found[3]) if found[3] else {}
        other, doubted = _other(tag, attributes, around.level)
        others += other
        links += tag == "a"
        doubt = around.doubt
        if doubted and not doubt:
            doubts += 1
            doubt = doubts
        level = max(around.level, 2 if tag == "article" else 1 if tag == "main" else 0)
        if not others and not doubt and tag in ("article", "main"):
            highest = max(highest, 2 if tag == "article" else 1)
        path = around.path
        if tag not in INLINE:
            name = next((w for n in attributes if n in NAMED for w in attributes[n].lower().split()[:1]), "")
            path = paths.setdefault((path, f"{tag}.{name}"), len(paths) + 1)
            walls.append(len(stack))
        places.setdefault(tag, []).append(len(stack))
        stack.append(_Open(tag, other, path, doubt, level))
    add(page[at:])
    flush()
    return out, highest


def _marks(block: Block) -> int:
    return len(_PUNCTUATION.findall(block.text)) if block.linked < len(block.text) else 0


def _passing(found: list[Block]) -> list[bool]:
    """Which blocks are content by their path's score alone?"""
    scores = fused_scores(found)
    sizes = np.array([len(b.text) for b in found], float)
    mean = float(np.average([scores[b.path] for b in found], weights=sizes))
    return [scores[b.path] >= THRESHOLD * mean and b.linked < 0.5 * len(b.text) for b in found]


def _cleared(found: list[Block]) -> list[Block]:
    """Without subtrees whose name speaks against them, unless their scores and texts speak for them."""
    if not any(b.doubt for b in found):
        return found
    size: dict[int, np.ndarray] = {}
    for b, passes in zip(found, _passing(found)):
        if b.doubt:
            own = (len(b.text) - b.linked) * np.array([passes, 1])
            size[b.doubt] = size.get(b.doubt, np.zeros(4)) + [*own, _marks(b), b.linked]
    clear = {d for d, (passing, own, marks, linked) in size.items() if own >= LONG and marks >= MARKS and linked < 0.25 * own and passing >= 0.5 * own}
    return [b for b in found if not b.doubt or b.doubt in clear]


def _chosen_level(found: list[Block], content: list[bool], level: int) -> int:
    """The innermost kind of marked element with the greater part of the content, else 0."""
    for n in range(level, 0, -1):
        own = [0, 0]
        marks = 0
        for b, passes in zip(found, content):
            if passes:
                own[b.level >= n] += len(b.text) - b.linked
                marks += _marks(b) if b.level < n else 0
        if INSIDE * own[1] >= own[0] or own[0] < LONG or marks < MARKS:
            return n
    return 0


def fused_scores(found: list[Block]) -> dict[int, float]:
    """Smoothed text ratio times smoothed punctuation ratio of every path."""
    paths = [b.path for b in found]
    kinds = sorted(set(paths))
    place = {p: n for n, p in enumerate(kinds)}
    index = np.array([place[p] for p in paths])
    own = np.array([len(b.text) - b.linked for b in found], float)
    marks = np.array([_marks(b) for b in found], float)
    count = np.bincount(index)
    ratios = [np.bincount(index, x) / count for x in (own, marks)]
    kernel = np.array([0.25, 0.5, 0.25])
    scores = np.ones(len(kinds))
    for ratio in ratios:
        line = np.pad(ratio[index], 1, mode="edge")
        smooth = np.convolve(line, kernel, "valid")
        scores *= 1 + np.bincount(index, smooth) / count
    return dict(zip(kinds, scores - 1))


def main_blocks(found: list[Block], level: int) -> list[Block]:
    """The blocks of the main text.

    A path needs a share of the mean score; headings stay when a content block follows
    them. An article or main element with the greater part of such content is kept
    whole, up to paths that are links through and through: its short lists and table
    cells have low ratios.
    """
    found = _cleared(found)
    if not found:
        return []
    content = _passing(found)
    level = _chosen_level(found, content, max(level, *(b.level for b in found), 0))
    if level:
        inside = [b for b in found if b.level >= level]
        linked: dict[int, list[int]] = {}
        for b in inside:
            linked.setdefault(b.path, []).append(b.linked >= 0.9 * len(b.text))
        menus = {p for p, x in linked.items() if len(x) > 2 and all(x)}
        return [b for b in inside if b.path not in menus]
    keep = list(content)
    for n, b in enumerate(found[:-1]):
        if b.heading and b.linked < len(b.text):
            keep[n] = keep[n] or content[n + 1]
    return [b for b, k in zip(found, keep) if k]


def main_text(page: str | None) -> str:
    """The main text: one line for each block, in page order."""
    return "\n".join(b.text for b in main_blocks(*blocks(page))) if page else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            texts = [main_text(x.as_py()) for x in part.column(2)]
            yield pa.record_batch(
                {
                    "page_id": part.column(0),
                    "url": part.column(1),
                    "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array([len(x) for x in texts], pa.int64()),
                }
            )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    Character references are decoded, white space inside a block becomes one space,
    empty blocks vanish. Null and empty pages, and pages without main text, get an
    empty text. Rows with null or repeated ids are rows like any other; further
    columns do not matter; an empty table gives no rows. Unclosed elements end with
    the element around them, an unclosed comment or script with the page.
    """
    return pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    ).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
