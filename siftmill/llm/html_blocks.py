"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags. The first pass decides by link density, length and the density of stop words,
and by the container: menus, headers, footers, sidebars, notices, adverts, forms and comments are out. Stop words keep blocks
but rule none out, and where the page's text shows none of their languages, length decides without them. Short and unclear
blocks stay open; the second pass gives them the label of the nearest decided block of their region (the article, or what
lies outside of one), of two as near ones the kept one. With nothing decided, an article's blocks stay and others go,
unless the whole page would be empty: then a container that holds most of its unlinked prose and went by a part of a compound class or id
alone ("header-image") counts again, or else all blocks stay that no container or link density ruled out. Parts of names
that say what a container lacks or has ("no-sidebar", "layout-with-sidebar") rule nothing out.

Null and empty pages have no blocks and an empty text; unclosed tags, comments and quotes reach no further than the page, and
cost no more than time linear in it; repeated rows are pages of their own; other columns are kept by ``extract``, but for ``blocks``
and ``text``, which it replaces.
"""

from __future__ import annotations

import html
import re
import sys
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Frequent function words of four languages.
STOP_WORDS = frozenset("""
a about all an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on one or our she so
that the their them there they this to was we were what when which who will with would you your
aber als am an auch auf aus bei bin das dass dem den der des die du durch ein eine einem einen einer es für hat ich ihr im in ist ja mit
nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur
au aux avec ce ces cette d dans de des du elle en est et eux il ils je la le les leur lui mais même n ne nous on ou où par pas plus pour qu que
qui s sa se ses son sont sur un une vous y
al como con cuando de del desde el ella en entre era es ese esta este ha hay la las le lo los más me mi muy no nos o para pero por porque que se
ser si sin sobre su sus también un una uno ya yo
""".split())
#: Elements that end a block.
BLOCK_TAGS = frozenset("""
address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head
header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul
""".split())
#: Elements whose content is no text of the page.
DROPPED = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "head")
#: Containers of boilerplate, by element, role, and words of class and id.
OUT_TAGS = frozenset("nav footer aside form menu dialog button select textarea fieldset title head".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form menu menubar toolbar alert".split())
OUT_WORDS = frozenset("""
ad ads adv advert advertisement adverts adsense alert banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright
disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination
paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor
sponsored subscribe subscription teaser toolbar widget
""".split())
#: Of these, the ones that also hold for an article element; elements that class and id say nothing about.
OUT_ARTICLES = frozenset("ad advert advertisement comment comments promo promoted recommended related replies reply sponsored teaser".split())
ROOTS = frozenset("html body main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LONG, SHORT = 140, 70
STOP_LOW, STOP_HIGH = 0.08, 0.2
LINKS_MOST = 0.5

_START = re.compile(r"<!--|<[!?]|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)")
_SPECIAL = re.compile(r"""[>"']""")
_ANGLE = re.compile("[<>]")
_RAW = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in DROPPED[:-1]}
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")
#: Characters that say about as much as three letters.
_DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")


#: Words of a class or id that say what a container has or lacks rather than what it is.
OTHERS = frozenset("no has have with without not".split())


def _is_out(tag: str, attrs: str, in_article: bool) -> str:
    """Whether an element is boilerplate: 'kind' by what it is or is called, 'name' by a part of a class or id alone, '' not at all."""
    if tag in OUT_TAGS or (tag == "header" and not in_article):
        return "kind"
    if not attrs or tag in ROOTS:
        return ""
    named, words = "", OUT_ARTICLES if tag == "article" else OUT_WORDS
    for name, value in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return "kind"
        if name == "role" and value in OUT_ROLES:
            return "kind"
        if name in ("class", "id"):
            for token in value.split():
                parts = re.split(r"[^a-z]+", token)
                if token in words:
                    return "kind"
                if OTHERS.isdisjoint(parts) and not words.isdisjoint(parts):
                    named = "name"
    return named


class _Tags:
    """The tags of a page, in order, found in time linear in the page, whatever is left open in it.

    A tag ends at the first '>' outside of quotes. Where there is none, it ends ahead of the next '<', or with the next '>'.
    A scan that failed passed some opening quotes; a later one that comes to one of them would go the same way and fails at once.
    """

    def __init__(self, page: str):
        self.page = page
        self.specials = [m.start() for m in _SPECIAL.finditer(page)]
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.dead: set[int] = set()

    def end(self, start: int) -> int:
        """Just behind the '>' that ends a tag whose name ends at ``start``, or -1."""
        if start > self.last[">"]:
            return -1
        page, specials, opened = self.page, self.specials, []
        k = bisect_left(specials, start)
        while k < len(specials):
            at = specials[k]
            if page[at] == ">":
                return at + 1
            if at in self.dead or at >= self.last[page[at]]:
                break
            opened.append(at)
            k = bisect_left(specials, page.find(page[at], at + 1) + 1, k)
        self.dead.update(opened)
        return -1

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, tag, whether it closes, attributes); comments, declarations and raw elements have no tag."""
        page, at = self.page, 0
        while m := _START.search(page, at):
            tag, close = (m["tag"] or "").lower(), bool(m["close"])
            if not tag:
                if m[0] == "<!--":
                    end = page.find("-->", m.end())
                    end = len(page) if end < 0 else end + 3
                elif m.end() > self.last[">"]:
                    at = m.end()
                    continue
                else:
                    end = page.find(">", m.end()) + 1
                yield m.start(), end, "", False, ""
            elif tag in _RAW and not close and m.end() <= self.last[">"]:
                found = _RAW[tag].search(page, page.find(">", m.end()))
                end = found.end() if found else len(page)
                yield m.start(), end, "", False, ""
            else:
                end = self.end(m.end())
                attrs = page[m.end() : end - 1] if end > 0 else ""
                if end < 0:
                    angle = _ANGLE.search(page, m.end())
                    end = len(page) if angle is None else angle.start() + (angle[0] == ">")
                yield m.start(), end, tag, close, attrs
            at = end


def blocks(page: str) -> list[dict]:
    """Blocks in page order: text, share of its characters in links, region (0: outside of articles), and whether a container
    rules it out (``out``); ``named`` is the number of the container that does so alone and by its name only, else 0."""
    out, parts, linked, stack = [], [], 0, []  # stack: (tag, rulers, named, region)
    open_tags: dict[str, int] = {}
    rulers, named, region, regions, containers, links, at = 0, 0, 0, 0, 0, 0, 0

    def flush() -> None:
        nonlocal parts, linked
        text = "".join(parts)
        if text and not text.isspace():
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append({"text": text, "links": min(1.0, linked / len(text)), "region": region, "out": rulers > 0, "named": named if rulers == 1 else 0})
        parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if links:
            linked += len(text.strip())

    for start, end, tag, close, attrs in _Tags(page):
        if start > at:
            add(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK_TAGS or tag in OUT_TAGS:
            flush()
        if tag == "a":
            links = 0 if close else 1
            continue
        if close:
            if open_tags.get(tag):
                flush()
                while True:
                    last = stack.pop()[0]
                    open_tags[last] -= 1
                    if last == tag:
                        break
                _, rulers, named, region = stack[-1] if stack else ("", 0, 0, 0)
            continue
        if tag in VOID or (tag not in BLOCK_TAGS and tag not in OUT_TAGS and not attrs):
            continue
        if tag == "body":
            stack, open_tags, rulers, named, region, links = [], {}, 0, 0, 0, 0
        if tag in ("article", "main"):
            links = 0
            away = _is_out(tag, attrs, True) or ("kind" if region > 0 and rulers else "")
            if region == 0 and not away:
                regions += 1
                region = regions
            rulers = 1 if away else 0
            containers += 1
            named = containers if away == "name" else 0
        elif tag == "p":  # needs no end; holds no container
            continue
        elif away := _is_out(tag, attrs, region > 0):
            if tag not in BLOCK_TAGS:
                flush()
            rulers += 1
            containers += 1
            if rulers == 1:
                named = containers if away == "name" else 0
        stack.append((tag, rulers, named, region))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    if at < len(page):
        add(page[at:])
    flush()
    return out


def _freed(found: list[dict]) -> bool:
    """Whether a container that held most of the page's unlinked prose, and was ruled out by its name alone, is let in again."""
    prose: dict[int, int] = {}
    for b in found:
        if b["links"] <= LINKS_MOST and len(b["text"]) >= SHORT:
            prose[b["named"]] = prose.get(b["named"], 0) + len(b["text"])
    most = max((n for n in prose if n), key=prose.get, default=0)
    if not most or 2 * prose[most] <= sum(prose.values()):
        return False
    for b in found:
        if b["named"] == most:
            b["out"], b["named"] = False, 0
    return True


def labelled(page: str | None) -> list[dict]:
    """Blocks with ``kept`` after both passes."""
    found = blocks(page or "")
    _decide(found)
    if not any(b["kept"] for b in found) and _freed(found):
        _decide(found)
    return found


def _decide(found: list[dict]) -> None:
    """Set ``kept`` of the blocks of a page."""
    of_page = of_stops = 0  # words of what isn't ruled out
    for b in found:
        words = _WORD.findall(b["text"].lower())
        b["words"], b["stops"] = len(words), sum(w in STOP_WORDS for w in words)
        b["kept"] = False if b["out"] or b["links"] > LINKS_MOST or b["text"][0] == "©" else None
        if b["kept"] is None:
            of_page, of_stops = of_page + b["words"], of_stops + b["stops"]
    listed = of_stops >= STOP_HIGH * of_page
    for b in found:
        stops = b["stops"] / b["words"] if b["words"] else 0.0
        size, inside = len(b["text"]) + 2 * len(_DENSE.findall(b["text"])), b["region"] > 0
        if b["kept"] is None and (
            (stops >= STOP_HIGH and size >= (SHORT if inside else LONG)) or (size >= LONG and (not listed or (stops >= STOP_LOW and inside)))
        ):
            b["kept"] = True
    first = [b["kept"] for b in found]
    regions: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        regions.setdefault(b["region"], []).append(i)
    for region, own in regions.items():
        decided = [i for i in own if first[i] is not None and not found[i]["out"]]
        before = 0
        for i in own:
            if first[i] is not None:
                continue
            while before < len(decided) and decided[before] < i:
                before += 1
            near = [j for j in decided[max(0, before - 1) : before + 1]]
            least = min((abs(j - i) for j in near), default=None)
            found[i]["kept"] = region > 0 if least is None else any(first[j] for j in near if abs(j - i) == least)
    if not any(b["kept"] for b in found):
        for b, was in zip(found, first, strict=True):
            b["kept"] = was is None


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with ``blocks`` (text, links, region, kept) in page order and ``text``, the kept ones joined by spaces."""

    @F.pandas_udf("array<struct<text:string,links:double,region:int,kept:boolean>>")
    def cut(pages: pd.Series) -> pd.Series:
        return pd.Series([[{k: b[k] for k in ("text", "links", "region", "kept")} for b in labelled(p)] for p in pages.tolist()])

    rows = pages.withColumn("blocks", cut("html"))
    return rows.withColumn("text", F.array_join(F.transform(F.filter("blocks", lambda b: b["kept"]), lambda b: b["text"]), " "))
