"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass labels each block by itself: blocks in
menus, page headers, footers, sidebars, notices, adverts, forms and comments are bad (elements say so
by name, or by a word of class, id or role; words on the page's own frame, and after ``has`` or ``no``,
say nothing, and part of a longer name such as ``notice-period`` is overruled by long dense text; a form
that holds most of the page is its frame); so are blocks with much link text; long blocks with many stop words are good; the rest is ambiguous. The second pass
gives ambiguous blocks the label of their nearest decided neighbours: those in the article and longer ones stay unless both sides are bad, short ones
follow the nearer side. Where a page has an ``article``
or ``main`` element, its borders count as good neighbours inside and bad ones outside.

Defined results: null or empty html gives an empty text; broken markup is read as far as it goes (an
unclosed comment or script ends with the page); a page without any good block gives an empty text;
rows are handled one by one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame

from simlens.llm.common import arrow_rows

# Element names by what they mean for the text.
HIDDEN = "script style noscript template iframe svg canvas object head title textarea select button label datalist".split()
BOILER = frozenset("nav footer aside menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                  "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article aside blockquote dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
# Words of class, id and role that mark a part as no text of the article.
HINTS = frozenset("ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert "
                  "popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar widget footer masthead comment comments commentlist disqus reply replies "
                  "respond share sharing social related recommended newsletter subscribe signup login search toolbar pagination pager skip copyright disclaimer "
                  "contentinfo complementary".split())
# Elements that frame the page or its text, beginnings of a name that deny what follows, and hints that mean little inside a longer name.
FRAME = frozenset("html body main article".split())
DENIALS = frozenset("has have no not with without".split())
WEAK_HINTS = frozenset("notice notices alert banner promotion search login skip copyright disclaimer consent cookie cookies subscribe".split())
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in is was for that it with as on by at from this are be an or not have has had but they you his her their which "
    "der die das und in von zu den mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son "
    "el los y del las una por con no su para al lo como más o pero sus le ya fue".split())

LONG, SHORT = 200, 70
DENSE, LINKED, LINKED_INSIDE = 0.3, 0.2, 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<hidden>" + "|".join(HIDDEN) + r")\b(?:[^\"'<>]++|\"[^\"]*+\"|'[^']*+'|[\"'])*+(?:/>|>.*?(?:</(?P=hidden)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*)(?P<rest>(?:[^\"'<>]++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<[!?][^<>]*>", re.S | re.I)
_HINT = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Block:
    __slots__ = ("text", "linked", "boiler", "inside", "weak", "form", "label")

    def __init__(self, text: str, linked: int, boiler: bool, inside: bool, weak: bool, form: bool):
        self.text, self.linked, self.boiler, self.inside, self.weak, self.form, self.label = text, linked, boiler, inside, weak, form, None


def hints_of(rest: str) -> tuple[bool, bool]:
    """Whether the attributes of an element mark it as no text of the article: surely, or weakly by part of a longer name."""
    weak = False
    for values in _HINT.findall(rest):
        for token in " ".join(values).lower().split():
            words = re.split(r"[_-]+", token)
            if words[0] in DENIALS:
                continue
            found = [w for w in words if w in HINTS]
            if found and (len(words) == 1 or any(w not in WEAK_HINTS for w in found)):
                return True, False
            weak = weak or bool(found)
    return False, weak


def page_blocks(html: str) -> list[Block]:
    """Blocks of a page in order: text, characters in links, and whether in boilerplate, in the article, under a weak hint or in a form."""
    out: list[Block] = []
    nothing = (False, False, False, False)
    stack: list[tuple[str, tuple]] = []
    place = nothing
    parts: list[str] = []
    links: list[str] = []
    in_link = False

    def flush():
        nonlocal parts, links
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(text, len(" ".join(unescape("".join(links)).split())), *place))
            parts, links = [], []

    def add(text: str):
        parts.append(text)
        if in_link:
            links.append(text)

    at = 0
    for found in _TOKEN.finditer(html):
        if found.start() > at:
            add(html[at:found.start()])
        at = found.end()
        name = found["name"]
        if not name:
            if found["hidden"] and found["hidden"].lower() == "head":
                flush()
            continue
        name, closing, rest = name.lower(), found["end"] == "/", found["rest"]
        if name in BLOCK:
            flush()
        elif name == "br":
            add(" ")
        if name == "a":
            in_link = not closing
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            else:
                continue
        elif name not in VOID and not rest.endswith("/"):
            hinted = weak = False
            if "=" in rest and name not in FRAME:
                hinted, weak = hints_of(rest)
            if name == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            if name in CONTAINER or name in FRAME or hinted or weak:
                was = stack[-1][1] if stack else nothing
                stack.append((name, (was[0] or hinted or name in BOILER or name == "header" and not was[1], was[1] or name in ("article", "main"), was[2] or weak, was[3] or name == "form")))
            elif name != "p":
                continue
        else:
            continue
        now = stack[-1][1] if stack else nothing
        if now != place:
            flush()
            place = now
    if at < len(html):
        add(html[at:])
    flush()
    return out


def first_pass(block: Block, has_article: bool) -> bool | None:
    """True: good, False: bad, None: ambiguous."""
    if block.boiler or has_article and not block.inside:
        return False
    size = len(block.text)
    linked = block.linked / size
    if linked > (LINKED_INSIDE if block.inside else LINKED):
        return False
    if not block.inside and ("©" in block.text or size < SHORT and block.linked):
        return False
    if size < SHORT:
        return False if block.weak else None
    words = [w.strip(".,;:!?()\"'").lower() for w in block.text.split()]
    dense = sum(w in STOP_WORDS for w in words) / len(words) >= DENSE
    if dense and size > LONG:
        return True
    return False if block.weak and not dense else None


def main_text(html: str) -> str:
    """Good blocks, joined by line feeds."""
    blocks = page_blocks(html)
    shown = sum(len(b.text) for b in blocks if not b.boiler)
    if 2 * sum(len(b.text) for b in blocks if b.form and not b.boiler) <= shown:
        for b in blocks:
            b.boiler = b.boiler or b.form
    has_article = any(b.inside and not b.boiler for b in blocks)
    for b in blocks:
        b.label = first_pass(b, has_article)
    n = len(blocks)
    # borders: of the article good, of a page without one bad, unless nothing on it was decided as good
    border = has_article or not any(b.label for b in blocks)
    before, after = [(border, n)] * n, [(border, n)] * n
    for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = (border, n)
        for i in order:
            b = blocks[i]
            last = (last[0], last[1] + 1)
            near[i] = last
            if has_article and (b.boiler or not b.inside):
                last = (True, n)           # leaving the article: its border is a good neighbour of what is inside
            elif b.label is not None:
                last = (b.label, 0)
    chosen = []
    for b, left, right in zip(blocks, before, after):
        label = b.label
        if label is None and (b.inside or len(b.text) >= SHORT):
            label = left[0] or right[0]    # dropped only between bad neighbours
        elif label is None:
            label = min(left, right, key=lambda side: (side[1], not side[0]))[0]
        if label:
            chosen.append(b.text)
    return "\n".join(chosen)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of ``pages`` (page_id, url, html)."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for columns in batches:
            html = columns["html"]
            for at in range(0, len(html), 500):
                texts = [main_text(h or "") for h in html[at:at + 500].to_pylist()]
                yield {"page_id": columns["page_id"][at:at + 500], "url": columns["url"][at:at + 500], "text": texts, "n_chars": [len(t) for t in texts]}

    return arrow_rows(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
