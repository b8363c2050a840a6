"""Main text of web pages by line-block distribution: markup is stripped to lines, text lengths are summed over sliding
windows of lines, and the text between surge and dive points is kept."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Lines in a window, and the characters that a window must hold to be a surge.
WINDOW = 3
SURGE = 80
#: Parts that never hold main text. Fixed values of the markup language.
SILENT = frozenset("script style noscript template svg math canvas iframe object audio video select textarea button option datalist title head".split())
ASIDE = frozenset("nav header footer aside form dialog menu fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul").split())
#: Words in class, id or role that name page furniture.
FURNITURE = frozenset(("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
                       "alert popup modal overlay sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toc comment "
                       "comments commentlist reply replies disqus respond discussion share sharing social related recommended newsletter subscribe subscription signup "
                       "login search footer header masthead topbar skip copyright legal disclaimer complementary contentinfo hidden").split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Za-z]+")
_RAW_END = {t: re.compile(rf"</{t}\s*[^>]*>|\Z", re.I | re.S) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}


#: The words among them that also tell an article element from the page's own article.
SMALL_ARTICLES = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related recommended teaser".split())


def furniture(attributes: str, words: frozenset[str] = FURNITURE) -> bool:
    """True if class, id or role name page furniture, or the part is hidden."""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            if any(w.lower() in words for part in value.split() for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", part))):
                return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return True
    return False


def lines_of(page: str, strict: bool = True) -> list[tuple[str, int, bool]]:
    """Lines in page order: text with single spaces, its characters outside links, whether it is inside the article.
    Not ``strict``: forms and parts that only their class tells are kept.

    Block elements end a line. A part that is dropped (scripts, navigation, forms, furniture by class) leaves an empty
    line, so it is a gap in the distribution.
    """
    out: list[tuple[str, int, bool]] = []
    text: list[str] = []
    stack: list[str] = []
    dropped, by_class, found = 0, False, False      # height of the stack where a dropped part began; why; article seen
    linked = [0]
    frames = {"article": 0, "main": 0}

    def close(gap: bool = False) -> None:
        joined = " ".join("".join(text).split())
        if joined or gap:
            out.append((joined, max(0, len(joined) - linked[0]), frames["article"] + frames["main"] > 0))
        text.clear()
        linked[0] = 0

    def say(raw: str) -> None:
        if raw and not dropped:
            plain = entities.unescape(raw)
            text.append(plain)
            if "a" in stack:
                linked[0] += len(" ".join(plain.split()))

    def leave(height: int) -> None:
        nonlocal dropped
        for name in stack[height:]:
            if name in frames:
                frames[name] -= 1
        del stack[height:]
        if dropped and len(stack) < dropped:
            dropped = 0

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name in stack:
                if name in BLOCK:
                    close()
                height = len(stack) - 1 - stack[::-1].index(name)
                # a stray inline end tag doesn't close the blocks above it
                if name in BLOCK or not any(t in BLOCK for t in stack[height + 1:]):
                    leave(height)
            elif name == "p":
                close()
            continue
        if name in BLOCK:
            close()
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):          # these end themselves where they recur
                same = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}[name]
                for h in range(len(stack) - 1, -1, -1):
                    if stack[h] in same:
                        leave(h)
                        break
                    if stack[h] in BLOCK:
                        break
        if name in _RAW_END and name in SILENT:
            at = _RAW_END[name].search(page, at).end()
            close(gap=True) if not dropped and name != "script" else None
            continue
        if name in VOID or m[3].rstrip().endswith("/"):
            continue
        stack.append(name)
        inside = frames["article"] > 0
        own = name == "main" or (name == "article" and not furniture(m[3], SMALL_ARTICLES))
        if own and dropped and by_class and not found:
            dropped = 0                 # a wrapper named after the page's furniture holds the article
        if name in frames:
            frames[name] += 1
        if not dropped:
            found |= own
            aside = name in ASIDE and not (name == "header" and inside) and (strict or name != "form")
            by_class = name not in ("html", "body") and not own and (name == "article" or strict and furniture(m[3]))
            if name in SILENT or aside or by_class:
                close(gap=True)
                dropped = len(stack)
    close()
    return out


def blocks_between(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Line ranges [from, to) from a surge (a window over the limit that text follows) to the dive (no text ahead)."""
    n = len(lengths)
    total = [sum(lengths[k:k + window]) for k in range(n)]
    ranges, k = [], 0
    while k < n:
        if total[k] >= surge and lengths[k] > 0:
            start = k
            while k < n and total[k] > 0 and lengths[k] > 0:
                k += 1
            ranges.append((start, k))
        else:
            k += 1
    return ranges


def main_text(page: str | None) -> str:
    """The article of a page. Where the page marks its article (or main part), its lines are the distribution and the
    limit of a surge is one character, as every line in it counts; otherwise all lines of the page are, links left out.
    A page without a surge gives its longest run of lines outside links."""
    lines = lines_of(page or "")
    if page and not any(s for s, _, _ in lines):
        lines = lines_of(page, strict=False)
    marked = any(inside and s for s, _, inside in lines)
    if marked:
        ranges = blocks_between([len(s) if inside else 0 for s, _, inside in lines], surge=1)
    else:
        lengths = [own for _, own, _ in lines]
        ranges = blocks_between(lengths)
        if not ranges and any(lengths):
            runs = blocks_between(lengths, surge=1)
            ranges = [max(runs, key=lambda r: sum(lengths[r[0]:r[1]]))] if runs else []
    return " ".join(lines[k][0] for a, b in ranges for k in range(a, b) if lines[k][0])


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars (code points).

    Null or empty pages give an empty text; repeated rows give repeated results; an empty table gives no rows; columns
    other than page_id, url, html are not read. Pages are read whole, one at a time in their own partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        run, "page_id bigint, url string, text string, n_chars bigint")
