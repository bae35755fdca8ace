"""The blocks of an HTML page, by one pass over its tags with a stack of the open elements."""

from __future__ import annotations

import re
from html import unescape
from typing import Any

# Names of the markup language.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
SECTIONS = frozenset("body article main section div td th blockquote aside nav header footer form".split())
BLOCKS = SECTIONS | frozenset(HEADINGS) | frozenset(
    "html head title p ul ol li dl dt dd table thead tbody tfoot tr pre figure figcaption address fieldset menu dialog details summary".split()
)
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}
HIDDEN = "script|style|noscript|template|svg|iframe|textarea|select"
CHROME = frozenset("head title nav header footer aside form menu dialog".split())
# Words of a class, id or role that name what is not content.
CHROME_WORDS = frozenset(
    "ad ads advert advertisement banner breadcrumb comments cookie menu nav navbar navigation popup promo related share sidebar social sponsor".split()
)
KINDS = {**{h: h for h in HEADINGS}, "li": "li", "dt": "li", "dd": "li", "tr": "row", "blockquote": "quote"}

# A comment or hidden element reaches to its end or that of the page; no tag reaches over another bracket. Nothing is
# read twice, however broken the page.
PIECE = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<hidden>{HIDDEN})\b.*?(?:</(?P=hidden)\b[^<>]*+>?|\Z)|<(?P<end>/?)(?P<name>[a-z][a-z0-9]*+)(?P<rest>[^<>]*+)>|<[!?][^<>]*+>|(?P<text>[^<]++|<)",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
WORD = re.compile(r"[a-z0-9]+")


def _is_chrome(name: str, rest: str, in_article: bool) -> bool:
    if name in CHROME and not (name == "header" and in_article):
        return True
    return any(not CHROME_WORDS.isdisjoint(WORD.findall(value.lower())) for value in NAMED.findall(rest))


def page_blocks(page: str | None) -> list[dict[str, Any]]:
    """Blocks in page order: ``kind, text, words, link_words, chrome, article, section_words``.

    A block is the text between two starts or ends of block elements, white space collapsed and character references read.
    ``chrome`` and ``article`` say whether any open element is one; ``section_words`` counts the words outside links of all
    blocks of the same section that are no chrome. A block element ends an open ``p``, an item the item before; an end tag
    ends all in its element, and one without a start does nothing. A link ends with its block.
    """
    found: list[dict[str, Any]] = []
    stack: list[tuple[str, str, bool, bool, int]] = [("", "text", False, False, 0)]  # name, kind, chrome, article, section
    opened: dict[str, int] = {}
    buffer: list[str] = []
    linked: list[str] = []
    link_depth = sections = 0  # depth at which the open link started, 0 without one
    filled = False  # the block has more than white space

    def close_block() -> None:
        nonlocal filled
        filled = False
        words = unescape("".join(buffer)).split()
        if words:
            _, kind, chrome, article, section = stack[-1]
            inside = len(unescape("".join(linked)).split())
            found.append({"kind": kind, "text": " ".join(words), "words": len(words), "link_words": min(inside, len(words)),
                          "chrome": chrome, "article": article, "section": section})
        buffer.clear()
        linked.clear()

    def pop() -> str:
        nonlocal link_depth
        name = stack.pop()[0]
        opened[name] -= 1
        if link_depth > len(stack):
            link_depth = 0
        return name

    for match in PIECE.finditer(page or ""):
        content, name = match["text"], match["name"]
        if content is not None:
            buffer.append(content)
            filled = filled or not content.isspace()
            if link_depth:
                linked.append(content)
            continue
        if name is None:
            if match["hidden"]:
                buffer.append(" ")
            continue
        name, ends = name.lower(), match["end"] == "/"
        if name == "a":
            link_depth = 0 if ends else len(stack)
            linked.append(" ")
        elif name in ("br", "hr"):
            buffer.append(" ")
        elif name in BLOCKS and not (ends and not opened.get(name)):
            cell = name in ("td", "th") and stack[-1][0] in ("tr", "td", "th")
            if not cell:
                close_block()
            if ends:
                while not (pop() == name):
                    pass
                continue
            if stack[-1][0] == "p":
                pop()
            while stack[-1][0] in ENDED_BY.get(name, ()):
                pop()
            _, kind, chrome, article, section = stack[-1]
            kind = kind if cell else KINDS.get(name, "text" if name in SECTIONS else kind)
            if cell:  # the cells of a row are one block
                if filled:
                    buffer.append(" | ")
            elif name in SECTIONS:
                sections += 1
                section = sections
            article = article or name in ("article", "main")
            stack.append((name, kind, chrome or _is_chrome(name, match["rest"], article), article, section))
            opened[name] = opened.get(name, 0) + 1
    close_block()
    totals: dict[int, int] = {}
    for block in found:
        if not block["chrome"]:
            totals[block["section"]] = totals.get(block["section"], 0) + block["words"] - block["link_words"]
    for block in found:
        block["section_words"] = totals.get(block.pop("section"), 0)
    return found
