"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one for each block of text, and text lengths are summed over sliding
windows of lines. Where the sum surges over a threshold a run of text begins, where it dives to
nothing the run ends; the lines between are kept. Tags and class words only weigh lines: those in a
marked article count IN_ARTICLE fold, lines that are mostly links count nothing elsewhere. Where a
marked article begins or ends, and where something is left out, blank lines make a dive. Runs in
marked articles are kept if the heaviest run is in one; of the others, those of some size next to the
heaviest. With them stay the other lines of the innermost element that holds most of their text (or
those that stand in no such element, if most do), so short blocks of an article are not lost.

Scripts, styles and hidden parts never hold text. Menus, headers, footers, sidebars, notices,
adverts, forms and reader comments are left out: they are known by their tags and by the words of
their class, id and role. A part that is so named only in passing (``page has-sidebar``), a form, and
a part that is never closed stay if they hold most of the page's text; one that is plainly named stays
only if it holds most of the text, in PARAGRAPHS and more blocks, and nothing else surges.

Defined cases: null or empty HTML gives an empty text; broken markup is read as far as it goes, and
in time proportional to its length; nothing is cut or capped; repeated rows each give a row. All
input columns stay, but one named like the output is replaced.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

WINDOW, SURGE, SHARE, LINKS, MOST = 3, 80, 0.25, 0.6, 0.6
#: How much more a line in a marked article counts; blocks that make a plainly named part an article.
IN_ARTICLE, PARAGRAPHS = 40, 3

# Looked up only where a ">" follows. Quotes end before the next "<", or else the tag at its first ">".
_tag = re.compile(r"<(?:[!?][^>]*|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"<]*\"|'[^'<]*'|[^'\"<>])*+)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*))>")
_attribute = re.compile(r"""(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden)(?![\w-])\s*+(?:=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_part = re.compile(r"[a-z0-9]+")
RAW = frozenset("script style textarea xmp iframe noembed noframes title template noscript".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
#: Elements without text of the page, and those that are parts around an article.
NO_TEXT = frozenset("button datalist head map math object select svg".split())
PARTS = frozenset("aside dialog footer form header menu nav".split())
#: Elements that may hold an article, and those that end where their like begins.
HELD = frozenset("article div main section".split())
ENDED = frozenset("dd dt li option p td th tr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that mark what is not the article.
WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments contentinfo cookie cookies complementary consent dialog disclaimer disqus footer gdpr header masthead menu menubar modal nav navbar navigation navigationbar newsletter notice notices notification pager pagination popup promo promotion promoted related replies search share sharing sidebar sidebars sidenav signup social sponsor sponsored subscribe toolbar topbar widget widgets login alert respond discussion".split())
ARTICLE = frozenset(["articlebody"])
#: Words that say that an element has such a part, or lacks it, not that it is one; words that inside
#: an article may mark its own head.
ABOUT, HEADS = frozenset("has have no with without hide show is".split()), frozenset("header masthead banner".split())
#: Names that templates also give to the article.
VAGUE = frozenset("widget widgets search share social modal dialog".split())
#: Words that a plain name may have beside: they say what kind of box the part is, or where.
BOXES = frozenset("area bar block box container content inner item left link links list main outer primary right secondary section site slot top bottom unit wrap wrapper global page row col form".split())
#: Words of a class, id or role by which an element calls itself the page or the article.
OWN = frozenset("wrapper page content container main article post entry body layout site story text".split())
#: What is still left out where the tag itself says article or main.
FOREIGN = frozenset("comment comments replies respond discussion related promo promoted sponsored ad ads advert adverts".split())
PLAIN, LOOSE = 2, 1


def _named(value: str, words: frozenset) -> int:
    """Does a class, id or role hold one of the words: plainly, loosely (among other words, or
    beside a name of the article's), or not at all?"""
    found, own = 0, False
    for name in value.split():
        parts = _part.findall(name)
        hits = [w for i, w in enumerate(parts) if w in words and not (i and parts[i - 1] in ABOUT)]
        if hits:
            plain = all(w in words or w in BOXES or w.isdigit() for w in parts) and not VAGUE.issuperset(hits)
            found = max(found, PLAIN if plain else LOOSE)
        elif parts and all(w in OWN for w in parts):
            own = True
    return LOOSE if found and own else found


def _marks(attributes: str, words: frozenset) -> tuple[int, bool, bool]:
    """How far a tag's attributes name a part that is left out; is it hidden; is it an article?"""
    named, hidden, article = 0, False, False
    for name, *values in _attribute.findall(attributes):
        value = next((v for v in values if v), "").lower()
        name = name.lower()
        if name == "hidden" or name == "aria-hidden":
            hidden |= name == "hidden" or value == "true"
        elif name == "itemprop":
            article |= value in ARTICLE
            named = max(named, PLAIN * (value == "comment"))
        else:
            article |= name == "role" and value in ("main", "article")
            named = max(named, _named(value, words))
    return named, hidden, article


class Page:
    """Lines and elements of a page, as they come. A line is (text, characters inside links, in a
    marked article, innermost element); blank ones stand where a marked article begins or ends. An
    element is (what holds it, how far it is named a part); 0 is none."""

    def __init__(self, page: str):
        self.lines: list[tuple[str, int, bool, int]] = []
        self.holder, self.part = [0], [0]
        self._read(page)

    def _read(self, page: str):
        buffer: list[str] = []
        link = linked = 0
        stack: list[tuple[str, int, bool]] = [("", 0, False)]
        open_: dict[str, int] = {}
        skip, depth = "", 0

        def end():
            nonlocal linked
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                self.lines.append((text, linked, stack[-1][2], stack[-1][1]))
            linked = 0

        def blank():
            end()
            if self.lines and self.lines[-1][0]:
                self.lines.extend([("", 0, False, 0)] * WINDOW)

        def pop():
            name, i, article = stack.pop()
            open_[name] -= 1
            if article and not stack[-1][2]:
                self.lines.extend([("", 0, False, 0)] * WINDOW)

        at, n, lower, gt, done = 0, len(page), None, -1, 0
        while at < n:
            lt = page.find("<", at)
            if gt < lt:
                gt = page.find(">", lt)
            comment = lt >= 0 and page.startswith("<!--", lt)
            m = _tag.match(page, lt) if lt >= 0 and gt >= 0 and not comment else None
            # a "<" that opens no tag is text
            if lt >= 0 and not m and not comment:
                if gt >= 0:
                    at = lt + 1
                    continue
                lt = -1
            if not skip and (text := page[done : lt if lt >= 0 else n]):
                buffer.append(text)
                if link:
                    linked += len(text.strip())
            if lt < 0:
                break
            if comment:
                stop = page.find("-->", lt + 4)
                at = done = n if stop < 0 else stop + 3
                continue
            at = done = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            close, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
            if name in RAW and not close:
                if lower is None:
                    lower = page.lower()
                    if len(lower) != n:  # a few letters change their length
                        lower = "".join(c.lower() if c < "\x80" else c for c in page)
                stop = lower.find("</" + name, at)
                at = done = n if stop < 0 else stop
                continue
            if skip:
                if name == skip:
                    depth += -1 if close else 1
                    if not depth:
                        skip = ""
                continue
            if name in BLOCKS or name in NO_TEXT:
                end()
            elif name in ("br", "td", "th"):
                buffer.append(" ")
            if name == "a":
                link = 0 if close else 1
            alone = name in VOID or attributes.endswith("/") and name not in BLOCKS
            if close:
                if open_.get(name):
                    if name not in BLOCKS and self.part[stack[-1][1]]:
                        end()
                    while stack[-1][0] != name:
                        if stack[-1][2] or self.part[stack[-1][1]]:
                            end()
                        # what stands open inside ends here; a part that is not closed is no sure one
                        self.part[stack[-1][1]] = min(self.part[stack[-1][1]], LOOSE)
                        pop()
                    pop()
                continue
            if alone:
                continue
            inside = stack[-1][2]
            words = WORDS & FOREIGN if name in ("article", "main") else WORDS - HEADS if inside else WORDS
            named, hidden, article = _marks(attributes, words) if attributes else (0, False, False)
            if name in NO_TEXT or hidden and name not in ("html", "body"):
                end()
                skip, depth = name, 1
                continue
            if name in ("html", "body"):
                named = 0
            elif name in PARTS and not (name == "header" and inside):
                named = max(named, LOOSE if name == "form" else PLAIN)
            if stack[-1][0] == name and name in ENDED or stack[-1][0] == "p" and name in BLOCKS:
                end()
                pop()
            # one like an open one is followed, too: its end must not end that one
            if not (named or article or name in HELD or open_.get(name)):
                continue
            if named:
                end()
            article = article or name in ("article", "main")
            if article and not inside:
                blank()
            self.holder.append(stack[-1][1])
            self.part.append(named)
            stack.append((name, len(self.holder) - 1, inside or article))
            open_[name] = open_.get(name, 0) + 1
        end()
        for name, i, _ in stack[1:]:
            self.part[i] = min(self.part[i], LOOSE)

    def sums(self, of) -> list[int]:
        """What the lines in each element add up to."""
        out = [0] * len(self.holder)
        for line in self.lines:
            out[line[3]] += of(line)
        for i in range(len(out) - 1, 0, -1):
            out[self.holder[i]] += out[i]
        return out

    def left_out(self, stay: frozenset = frozenset()) -> list[bool]:
        """For each element, is it in a part that is left out?"""
        out = [False] * len(self.holder)
        for i in range(1, len(out)):
            out[i] = out[self.holder[i]] or bool(self.part[i]) and i not in stay
        return out


def _plain(line) -> int:
    """The text of a line that is not mostly links."""
    return len(line[0]) if line[1] < LINKS * len(line[0]) else 0


def window_sums(size: list[int], window: int = WINDOW) -> list[int]:
    sums, total = [0] * len(size), 0
    for i in range(len(size) - 1, -1, -1):
        total += size[i] - (size[i + window] if i + window < len(size) else 0)
        sums[i] = total
    return sums


def runs(size: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Where the sums of windows surge and dive: (first line, line after the last) of each run."""
    sums, out, i = window_sums(size, window), [], 0
    while i < len(size):
        if sums[i] >= surge and size[i]:
            j = i
            while j < len(size) and sums[j]:
                j += 1
            out.append((i, j))
            i = j
        else:
            i += 1
    return out


def _gaps(page: Page, gone: list[bool]) -> list[tuple[str, int, bool, int]]:
    """The lines, with blank ones in place of what is left out."""
    out = []
    for x in page.lines:
        if not gone[x[3]]:
            out.append(x)
        elif out and out[-1][0]:
            out.extend([("", 0, False, 0)] * WINDOW)
    return out


def innermost(lines, holder: list[int], size: list[int]) -> set[int]:
    """The innermost element of most of some lines' weight, and the elements in it."""
    held = [0] * len(holder)
    for x, n in zip(lines, size, strict=True):
        held[x[3]] += n
    for i in range(len(held) - 1, 0, -1):
        held[holder[i]] += held[i]
    # an element that opens later and has most of the text stands inside the earlier ones
    found = max((i for i, n in enumerate(held) if n >= MOST * held[0]), default=0)
    if not found:
        # the page itself, but not the elements in it
        return {0} if held[0] and sum(n for x, n in zip(lines, size, strict=True) if not x[3]) >= MOST * held[0] else set()
    out = {found}
    for i in range(found + 1, len(holder)):
        if holder[i] in out:
            out.add(i)
    return out


def kept(page: Page, gone: list[bool], window: int = WINDOW, surge: int = SURGE) -> tuple[list[str], bool]:
    """The lines between surge and dive points; is there a surge at all?"""
    lines = _gaps(page, gone)
    size = [len(x[0]) * IN_ARTICLE if x[2] else _plain(x) for x in lines]
    found = runs(size, window, surge)
    if not found:
        return [x[0] for x in lines if x[0] and x[2]] or [x[0] for x, s in zip(lines, size, strict=True) if s] or [x[0] for x in lines if x[0]], False
    weight = [sum(size[a:b]) for a, b in found]
    heaviest = max(zip(weight, found, strict=True), key=lambda x: x[0])[1]
    marked = lines[heaviest[0]][2]
    chosen = [0] * len(size)
    for (a, b), w in zip(found, weight, strict=True):
        if w >= SHARE * max(weight) or marked and lines[a][2]:
            chosen[a:b] = size[a:b]
    inside = innermost(lines, page.holder, chosen)
    # between the first and the last of them, lines of links belong to the article, too
    at = [i for i, c in enumerate(chosen) if c]
    return [x[0] for i, (x, n) in enumerate(zip(lines, size, strict=True)) if chosen[i] or (n or x[0] and at[0] < i < at[-1]) and (x[3] in inside or marked and x[2])], True


def main_text(page: str | None) -> str:
    if not page:
        return ""
    page = Page(page)
    held, blocks = page.sums(_plain), page.sums(lambda x: 1 if _plain(x) else 0)
    most = [i for i in range(1, len(held)) if page.part[i] and held[i] and held[i] >= MOST * held[0]]
    loose = frozenset(i for i in most if page.part[i] == LOOSE)
    found, surges = kept(page, page.left_out(loose))
    if not surges and len(loose) < len(most):
        plain = frozenset(i for i in most if page.part[i] == PLAIN and blocks[i] >= PARAGRAPHS)
        if plain:
            found, _ = kept(page, page.left_out(loose | plain))
    return "\n\n".join(found)


def extract(df: DataFrame, html_col: str = "html", output: str = "text") -> DataFrame:
    """Adds the main text of each page."""
    field = T.StructField(output, T.StringType(), False)
    return common.with_columns(df, [field], lambda pages: [[main_text(x) for x in pages]], html_col)
