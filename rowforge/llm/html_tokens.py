"""Blocks of a page: the tokens that wrappers are inferred from.

A helper for Arrow tasks: one pass over the characters of one page.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Their content is no markup.
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
#: All that a head holds; anything else ends it.
HEAD = frozenset("head title meta link base script style noscript template".split())
#: They mark up words inside a block and begin none.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)
#: A paragraph ends where one of these begins.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: These end an open element of their own kind.
ENDS_OWN_KIND = frozenset("li dt dd tr td th option thead tbody tfoot".split())
#: Containers that an end tag of another container does not reach past.
SECTIONS = frozenset("article aside body footer form header html main nav section table ul ol dl div".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # a quote opens a value after = only, and only if it is closed; no step is ever taken back
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)",
    re.S,
)
#: Every attribute, so that the text of a value is not read as one.
_ATTRIBUTE = re.compile(r"([^\s/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s]*+)))?+")
#: Numbers in names differ from page to page.
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Block:
    """Text of one block, the elements around it, how much of it is in links, and the numbers
    of the elements around it on its page, which tell equal neighbours apart."""

    path: tuple[str, ...]
    text: str
    linked: int
    elements: tuple[int, ...] = ()


def _label(name: str, attributes: str) -> str:
    """Element name with the words of its class, id and role."""
    marks = []
    for found in _ATTRIBUTE.finditer(attributes) if attributes.strip() else ():
        key = found[1].lower()
        value = found[2] or found[3] or found[4] or ""
        if key in ("class", "id", "role"):
            marks += value.lower().split()
        elif key == "hidden" or key == "style" and "display:none" in value.replace(" ", "").lower():
            marks.append("hidden")
    return " ".join([name, *sorted({_DIGITS.sub("0", m) for m in marks})])


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order; scripts, styles, comments and head are left out."""
    if not page:
        return []
    found: list[Block] = []
    open_names: list[str] = []
    labels: list[str] = []
    numbers: list[int] = []
    opened = 0
    pieces: list[str] = []
    links, linked = 0, 0

    def end_block() -> None:
        nonlocal linked
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                found.append(Block(tuple(labels), text, linked, tuple(numbers)))
            pieces.clear()
        linked = 0

    def end_head() -> None:
        if "head" in open_names:
            close(open_names.index("head"))

    def say(text: str) -> None:
        nonlocal linked
        if text and not text.isspace():
            end_head()
        if text and "head" not in open_names:
            pieces.append(text)
            if links:
                linked += len(text.strip())

    def close(depth: int) -> None:
        del open_names[depth:], labels[depth:], numbers[depth:]

    at = 0
    while markup := _MARKUP.search(page, at):
        say(page[at : markup.start()])
        at = markup.end()
        if markup[2] is None:
            if markup[0].startswith("<![CDATA["):
                say(html.escape(markup[0][9:].removesuffix("]]>")))
            continue
        name, ending = markup[2].lower(), bool(markup[1])
        if not ending and name not in HEAD:
            end_head()
        if name in INLINE:
            if name == "a":
                links = max(0, links - 1) if ending else links + 1
            elif name == "br":
                say(" ")
            continue
        if name in RAW:
            if not ending and not markup[3].rstrip().endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        end_block()
        links = 0
        if name in VOID:
            continue
        if ending:
            # the innermost open element of the name, unless a section is in between
            for depth in range(len(open_names) - 1, -1, -1):
                if open_names[depth] == name:
                    close(depth)
                    break
                if open_names[depth] in SECTIONS and name not in SECTIONS:
                    break
            continue
        if name in ENDS_PARAGRAPH and open_names and open_names[-1] == "p":
            close(len(open_names) - 1)
        if name in ENDS_OWN_KIND and open_names and open_names[-1] == name:
            close(len(open_names) - 1)
        open_names.append(name)
        labels.append(_label(name, markup[3]))
        opened += 1
        numbers.append(opened)
    say(page[at:])
    end_block()
    return found
