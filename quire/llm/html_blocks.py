"""Leaf blocks of a web page: visible text by block element and line, with its ancestors. One regex pass, no tree."""

from __future__ import annotations

import html as _html
import re
from typing import NamedTuple

# Fixed values of HTML: elements without content, elements never shown, elements that run within a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template head title iframe object svg select textarea".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
INLINE = frozenset(
    "a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark math mi mn mo mfrac msup msub mrow mtext msqrt "
    "q rp rt ruby s samp small span strike strong sub sup time tt u var big".split()
)
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "td": {"td", "th", "p", "li"}, "th": {"td", "th", "p", "li"}, "tr": {"tr", "td", "th", "p", "li"},
    "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"},
}
_BLOCK_IN_P = frozenset(
    "address article aside blockquote center div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0(?![.\d])|opacity\s*:\s*0(?:\.0*)?(?![.\d])", re.I)
_BLANK = re.compile(r"\s+")


class Block(NamedTuple):
    line: int  # line of the html, from 1
    text: str  # visible text, references resolved, blanks collapsed
    path: tuple[tuple[str, str], ...]  # ancestors from the outermost: (tag, class or id)
    links: int  # characters of the text inside links
    emphasis: int  # characters inside bold
    code: bool  # inside pre or code


class Page(NamedTuple):
    title: str
    blocks: list[Block]
    noscript: str  # text shown to a reader without scripts
    scripts: int


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw.strip(" /") else {}


def parse(html: str) -> Page:
    """The blocks of a page. Broken markup never fails: unclosed elements end with their parent, stray ends are skipped."""
    stack: list[tuple[str, str, bool]] = []
    path: tuple[tuple[str, str], ...] = ()
    hidden = links = bold = code = 0
    line = 1
    blocks: list[Block] = []
    parts: list[str] = []
    linked = strong = coded = 0
    title: list[str] = []
    noscript: list[str] = []
    scripts = 0

    def flush() -> None:
        nonlocal linked, strong, coded
        if parts:
            text = _BLANK.sub(" ", "".join(parts)).strip()
            if text:
                blocks.append(Block(line, text, path, linked, strong, coded > 0))
            parts.clear()
        linked = strong = coded = 0

    def pop() -> None:
        nonlocal hidden, links, bold, code, path
        tag, _, hides = stack.pop()
        hidden -= hides
        if tag == "a":
            links -= 1
        elif tag in ("b", "strong"):
            bold -= 1
        elif tag in ("pre", "code"):
            code -= 1
        if tag not in INLINE:
            path = path[:-1]

    end = len(html)
    at = 0
    while at < end:
        m = _TOKEN.match(html, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            text = m.group()
            if text[0] == "<" and len(text) > 1:
                line += text.count("\n")
                continue
            if hidden:
                line += text.count("\n")
                continue
            if "\n" not in text:
                text = _html.unescape(text)
                parts.append(text)
                n = len(text.strip())
                linked += n * (links > 0)
                strong += n * (bold > 0)
                coded += code
                continue
            for k, piece in enumerate(text.split("\n")):
                if k:
                    flush()
                    line += 1
                piece = _html.unescape(piece)
                if piece:
                    parts.append(piece)
                    n = len(piece.strip())
                    linked += n * (links > 0)
                    strong += n * (bold > 0)
                    coded += code
            continue
        tag = tag.lower()
        feeds = m.group().count("\n")
        if m.group(1):  # end tag
            if tag not in INLINE:
                flush()
            line += feeds
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in ("table", "td", "div", "article", "main", "body") and tag in INLINE | {"p", "li"}:
                    break
            continue
        if tag not in INLINE and tag != "br":
            flush()
        line += feeds
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            body, after = (html[at : stop.start()], stop.end()) if stop else (html[at:], end)
            if tag == "title" and not title:
                title.append(_BLANK.sub(" ", _html.unescape(body)).strip())
            elif tag == "noscript":
                noscript.append(_BLANK.sub(" ", _html.unescape(re.sub(r"<[^>]*>", " ", body))).strip())
            elif tag == "script":
                scripts += 1
            line += html.count("\n", at, after)
            at = after
            continue
        if tag in VOID:
            continue
        closes = CLOSES.get(tag) or ({"p"} if tag in _BLOCK_IN_P else None)
        if closes:
            while stack and stack[-1][0] in closes:
                pop()
        raw = m.group(3)
        hides, name = tag in UNSEEN, ""
        if raw and raw.strip(" /"):
            attrs = attributes(raw)
            name = attrs.get("class") or attrs.get("id") or ""
            hides = hides or "hidden" in attrs or attrs.get("aria-hidden") == "true" or ("style" in attrs and _HIDING.search(attrs["style"]) is not None)
        stack.append((tag, name, hides))
        hidden += hides
        if tag == "a":
            links += 1
        elif tag in ("b", "strong"):
            bold += 1
        elif tag in ("pre", "code"):
            code += 1
        if tag not in INLINE:
            path = (*path, (tag, name))
    flush()
    return Page(title[0] if title else "", blocks, " ".join(x for x in noscript if x), scripts)
