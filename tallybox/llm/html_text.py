"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. First pass: blocks are classified by
link density, length and the density of stop words, or by sentences where a page has
none of the known stop words; the structure around a block (menus, footers, forms,
adverts, reader comments) decides at once. Second pass: blocks of middle length are
good beside one of their kind or a good one; ambiguous short blocks take the label of
the nearest decided neighbours, within the article if they stand in one, past link
lists and boxes in it. Good blocks are joined in page order. Class names and ids count
by whole names, never on a page's body or article; parts that speak of comments or
notices count within longer names as well. Where names would leave a page without
text, they are set aside, but for whole names of reader comments. A link holds the
blocks up to its end tag. On a page of short blocks only, those outside of ruled-out
structure are its text.

Each page is read on its own, whole. Null and empty pages have an empty text; repeated
pages give repeated rows; an empty table gives an empty table; other columns than the
id, the url and the html are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of four languages.
STOP_WORDS = frozenset(
    (
        "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over me even most made after also did many"
        " der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde"
        " de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son aux mais comme cette on sa ses leur été être fait nous vous elle"
        " el los y las por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde"
    ).split()
)
#: Elements whose content is no text. RAW ones end at their end tag or with the page; of the others an unclosed one ends at the next block.
RAW = "script|style"
SILENT = "noscript|template|svg|math|iframe|object|canvas|audio|video|textarea|select|button|title"
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Tags that must be closed, so that what stands between can be told.
HOLDS = frozenset("article aside body details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
SILENT_TAGS = frozenset(SILENT.split("|"))
BAD_TAGS = frozenset("aside dialog footer form menu nav".split())
#: Parts of class names and ids. A name rules an element out if it has a bad part and no other than these.
COMMENT_PARTS = frozenset("comment comments disqus replies reply respond".split())
BAD_PARTS = COMMENT_PARTS | frozenset("ad ads advert adverts advertisement advertisements alert alerts banner banners breadcrumb breadcrumbs consent cookie cookies dialog disclaimer footer gdpr legal login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pagination paywall pager popup popups promo promos promoted recommended related search share sharing sidebar sidebars signup social sponsor sponsored subscribe tag tags toolbar topbar widget widgets".split())
#: Parts that rule out in any company, in names of up to MOST_PARTS parts; and parts of names that tell a state, not a kind.
ALONE_PARTS = frozenset("comment comments disclaimer disqus notice notices paywall".split())
STATE_PARTS = frozenset("allow allowed closed disabled enabled has hide hidden no open with without".split())
MOST_PARTS = 4
NEUTRAL_PARTS = frozenset("area article articles bar block bottom box buttons column container content entry form global group header holder icons inner item items left links list main message outer page panel post posts primary right row secondary section side site slot sticky text thread title top unit user wrap wrapper".split())
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
BAD_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog form menu menubar toolbar".split())
PIECE = re.compile(rf"""<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>"']*(?:"[^"]*"[^<>"']*|'[^']*'[^<>"']*)*)>|<[!/?a-zA-Z][^<>]*>""", re.DOTALL | re.IGNORECASE)
LINK_TAG = re.compile(r"<(/?)a(?=[\s/>])", re.IGNORECASE)
SILENT_TAG = re.compile(rf"<(/?)({SILENT})(?=[\s/>])[^<>]*>", re.IGNORECASE)
SENTENCE = re.compile(r"[.!?…。！？।؟]")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
EDGE = re.compile(r"^[^\w]+|[^\w]+$")

SHORT, LONG, LINKS, STOP_LOW, STOP_HIGH = 70, 200, 0.33, 0.10, 0.22
GOOD, BAD, OPEN, APART, NEAR = 1, -1, 0, -2, 2


def _named(attrs: str, parts: frozenset[str]) -> bool:
    """Whether a class or the id is made of such parts, and neutral ones."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs)}
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        own = {p.lower() for p in PARTS.findall(name)}
        if own & parts and own <= BAD_PARTS | NEUTRAL_PARTS:
            return True
    return False


def _speaks(attrs: str) -> bool:
    """Whether a class or the id has a part of comments or notices, in any company but a state's."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs)}
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        own = [p.lower() for p in PARTS.findall(name)]
        if len(own) <= MOST_PARTS and ALONE_PARTS.intersection(own) and not STATE_PARTS.intersection(own):
            return True
    return False


def _bad(tag: str, attrs: str, in_article: bool) -> bool:
    """Whether an element's kind or role rules it out."""
    if tag in BAD_TAGS or tag == "header" and not in_article:
        return True
    if not attrs:
        return False
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attrs)}
    return found.get("role") in BAD_ROLES or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "") or bool(re.search(r"\bhidden\b", ATTRIBUTE.sub("", attrs)))


def _silent_ends(page: str) -> dict[int, int]:
    """Where elements without text end, by where they start; only those whose next tag of the kind is their end tag."""
    ends, opened = {}, {}
    for m in SILENT_TAG.finditer(page):
        tag = m[2].lower()
        if not m[1]:
            opened[tag] = m.start()
        elif tag in opened:
            ends[opened.pop(tag)] = m.end()
    return ends


def _closed_links(page: str) -> set[int]:
    """Where links start whose next tag of the kind is their end tag."""
    closed, opened = set(), None
    for m in LINK_TAG.finditer(page):
        if m[1] and opened is not None:
            closed.add(opened)
        opened = None if m[1] else m.start()
    return closed


def blocks(page: str) -> list[tuple[str, int, bool, int, bool]]:
    """(text, characters in links, ruled out by structure, number of its article or 0, ruled out by a name alone)."""
    out, text, linked = [], [], 0
    stack: list[tuple[str, bool, int, bool, bool]] = [("", False, 0, False, False)]  # tag, ruled out, article, ruled out with any article inside, by name
    in_link, mute, articles, at, skip = False, False, 0, 0, 0
    over = 0  # depth at which a link began that may hold blocks, or 0
    ends, closed = _silent_ends(page), _closed_links(page)

    def flush() -> None:
        nonlocal text, linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                _, bad, article, _, named = stack[-1]
                out.append((whole, linked, bad or named, article, named and not bad))
        text, linked = [], 0

    def add(part: str) -> None:
        nonlocal linked
        if part and not mute:
            text.append(part)
            if in_link:
                linked += len(" ".join(html.unescape(part).split()))

    for m in PIECE.finditer(page):
        if m.start() < skip:
            at = max(skip, m.end()) if m.end() > skip else at
            continue
        add(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if tag == "a":
            in_link = not m[2]
            over = len(stack) if in_link and m.start() in closed and "href" in (m[4] or "").lower() else 0
        elif tag == "br":
            text.append(" ")
        elif m.start() in ends:
            at = skip = ends[m.start()]
        elif tag in SILENT_TAGS and not m[2] and not (m[4] or "").endswith("/"):
            mute = True
        if tag not in BLOCK:
            continue
        flush()
        in_link, mute = over > 0, False
        if tag not in HOLDS:
            continue
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    if k < over:  # the element that held the link has ended
                        in_link, over = False, 0
                    break
            continue
        _, bad, article, firm, named = stack[-1]
        own = _bad(tag, m[4] or "", article > 0)
        name = tag not in ("article", "body", "main") and bool(m[4]) and (_named(m[4], BAD_PARTS) or _speaks(m[4]))
        comments = name and _named(m[4], COMMENT_PARTS)
        if tag in ("article", "main") and not own and not article and not firm:
            # an advert or a notice left open doesn't swallow the article after it
            articles += 1
            bad, article, named = False, articles, False
        firm = firm or tag in ("aside", "footer", "nav") or comments
        stack.append((tag, bad or own or comments, article, firm, named or name and not comments))
    add(page[at:])
    flush()
    return out


def _density(text: str) -> float:
    words = [EDGE.sub("", w).lower() for w in text.split()]
    return sum(w in STOP_WORDS for w in words) / len(words)


def first_pass(found: list[tuple[str, int, bool, int, bool]]) -> list[int]:
    """GOOD, BAD, NEAR (good if a neighbour is near or good), OPEN (short), or APART (links and boxes in an article, which say nothing of its text)."""
    dense = [_density(text) if len(text) >= SHORT and not bad else 0.0 for text, _, bad, _, _ in found]
    # where no block has the stop words of a known language, sentences stand for them
    foreign = all(d < STOP_LOW for d in dense)
    out = []
    for (text, linked, bad, article, _), d in zip(found, dense, strict=True):
        n = len(text)
        if foreign and SENTENCE.search(text):
            d = STOP_HIGH
        if bad or linked > LINKS * n:
            out.append(APART if article else BAD)
        elif n < SHORT:
            out.append(OPEN)
        elif d >= STOP_HIGH and n >= LONG or article and d >= STOP_LOW:
            out.append(GOOD)
        elif d >= STOP_HIGH:
            out.append(NEAR)
        elif d >= STOP_LOW or article:
            out.append(OPEN)
        else:
            out.append(BAD)
    return out


def second_pass(first: list[int], regions: list[int]) -> list[int]:
    """GOOD or BAD for each block: NEAR ones by their company, then OPEN ones by the nearest decided neighbours of their region."""

    def decided(own: list[int], kinds: tuple[int, ...], order: range) -> dict[int, tuple[int, int]]:
        """For each block the last one of these kinds before it, in this order and its own region: (place, kind)."""
        seen, last, region = {}, None, None
        for k in order:
            if regions[k] != region:
                last, region = None, regions[k]
            if last:
                seen[k] = last
            if own[k] in kinds:
                last = (k, own[k])
        return seen

    def both(own: list[int], kinds: tuple[int, ...]) -> list[list[tuple[int, int]]]:
        sides = decided(own, kinds, range(len(own))), decided(own, kinds, range(len(own) - 1, -1, -1))
        return [[s[k] for s in sides if k in s] for k in range(len(own))]

    in_article = any(x == GOOD and r for x, r in zip(first, regions, strict=True))
    company = both(first, (GOOD, BAD, NEAR))
    own = list(first)
    for k, x in enumerate(first):
        if x == NEAR:
            good = any(kind in (GOOD, NEAR) for _, kind in company[k]) or not company[k]
            own[k] = GOOD if good and (regions[k] or not in_article) else BAD
    near, out = both(own, (GOOD, BAD)), []
    for k, x in enumerate(own):
        if x != OPEN:
            out.append(GOOD if x == GOOD else BAD)
            continue
        least = min((abs(at - k) for at, _ in near[k]), default=0)
        closest = {kind for at, kind in near[k] if abs(at - k) == least}
        out.append(closest.pop() if len(closest) == 1 else GOOD if regions[k] else BAD)
    return out


def _short_page(found: list[tuple[str, int, bool, int, bool]], first: list[int], least: int) -> list[int] | None:
    """GOOD for the short blocks outside of ruled-out structure, if nothing else stands there and ``least`` of them are sentences."""
    free = [k for k, b in enumerate(found) if not b[2]]
    if not free or any(first[k] != OPEN for k in free) or sum(bool(SENTENCE.search(found[k][0])) for k in free) < least:
        return None
    return [BAD if b[2] else GOOD for b in found]


def labels(found: list[tuple[str, int, bool, int, bool]]) -> list[int]:
    """GOOD or BAD for each block. Where a page has no other text, its short blocks are taken, then what only a name rules out is judged by its text."""
    regions, first = [b[3] for b in found], first_pass(found)
    out = second_pass(first, regions)
    if GOOD in out:
        return out
    short = _short_page(found, first, 2)
    if short is None and any(b[4] for b in found):
        out = second_pass(first_pass([(*b[:2], b[2] and not b[4], *b[3:]) for b in found]), regions)
    if GOOD in out:
        return out
    return short or _short_page(found, first, 0) or out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b[0] for b, label in zip(found, labels(found), strict=True) if label == GOOD)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row: id, url, text, n_chars; see the module."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(h.as_py()) for h in b.column(2)], pa.string())], ["id", "url", "text"])

    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
