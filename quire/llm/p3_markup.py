"""Problem 3: markup residue in text, and page wrappers inferred as union-free regular expressions."""

from __future__ import annotations

import difflib
import html as _html
import json
import re
from collections.abc import Iterator
from html.entities import html5

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.urls import site_key
from quire.llm.html_blocks import Block, Page, parse
from quire.operators.shared import sized_broadcast

# Elements of HTML.
TAGS = (
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption center "
    "cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark marquee math menu meta "
    "meter nav nobr noframes noscript object ol optgroup option output p param picture pre progress q rb rp rt rtc ruby s samp script search "
    "section select slot small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr "
    "track tt u ul var video wbr xmp"
).split()
_TAG = re.compile(r"</?(?:" + "|".join(sorted(TAGS, key=len, reverse=True)) + r")(?=[\s/>])(?:\s+[a-zA-Z_:@][-\w:.]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>=]+))?)*\s*/?>", re.I)
_COMMENT = re.compile(r"<!--.*?-->|<!DOCTYPE\s[^>]*>|<!\[CDATA\[", re.S | re.I)
_REFERENCE = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|([a-zA-Z][a-zA-Z0-9]{1,30}));")

_FENCE = re.compile(r"^[ \t]*(?:```|~~~)[\w+-]*[ \t]*$", re.M)
_HEADING = re.compile(r"^[ \t]{0,3}#{1,6}[ \t]+(?=\S)[^\n]*\w", re.M)
_BULLET = re.compile(r"^[ \t]*[*+-][ \t]+(?![*+-](?:\s|$))(?=\S)[^\n]*\w", re.M)
_QUOTE = re.compile(r"^[ \t]{0,3}>[ \t]?(?=\S)[^\n]*\w", re.M)
_RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$", re.M)
_LINK = re.compile(r"!?\[[^\[\]\n]*\]\((?:[^()\s]+|<[^<>\n]*>)(?:\s+\"[^\"\n]*\")?\)|^\[[^\]\n]+\]:\s+\S+", re.M)
_STRONG = re.compile(r"(?<![*\w\\])(\*{1,3})(?=[^\s*])(?:[^*\n]|\*(?!\*))*?(?<=[^\s*])\1(?![*\w])|(?<![*\\])(\*{2,3})(?=[^\s*])[^*\n]+?(?<=[^\s*])\2(?!\*)")
_STRONG_CJK = re.compile(r"(?<![*\w\\])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?!\*)|(?<=[぀-ヿ一-鿿])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*")
_UNDER = re.compile(r"(?<![\w_\\])(_{1,3})(?=[^\s_])(?:[^_\n]|(?<=\w)_(?=\w))*?(?<=[^\s_])\1(?![\w_])")
_STRIKE = re.compile(r"(?<!~)~~(?=[^\s~])[^~\n]+?(?<=[^\s~])~~(?!~)")
_TICK = re.compile(r"(?<!`)(`{1,2})(?=[^\s`])[^`\n]+?(?<=[^\s`])\1(?!`)")
_SHOUT = re.compile(r"_+[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*_+\Z")

_WIKI_LINK = re.compile(r"\[\[(?![+*~$%!{])[^\[\]\n]+(?:\[\[[^\[\]\n]*\]\][^\[\]\n]*)*\]\]")
_WIKI_QUOTES = re.compile(r"(?<!')('{2,3}|'{5})(?=[^'\s])[^'\n]*(?:'[^'\n]+)*?(?<=[^\s])\1(?!')")
_WIKI_HEADING = re.compile(r"^[ \t]*(={2,6})[ \t]*(?=[^=\s])[^=\n]+?[ \t]*\1[ \t]*$", re.M)
_WIKI_TEMPLATE = re.compile(r"\{\{(?![#/^{+*~$%!])[^{}|\n]{1,60}\|[^{}\n]*\}\}|\{\{(?![#/^{+*~$%!])[A-Z][^{}|\n]{1,60}(?:\n\|[^{}]*)?\}\}")
_WIKI_TABLE = re.compile(r"^[ \t]*(?:\{\|[^\n]*|\|\}[ \t]*|\|-+[ \t]*)$|^[ \t]*[|!](?![|-])[^|\n]+(?:\|\||!!)[^\n]+$", re.M)

_TEX_COMMAND = re.compile(r"\\(?:[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{|(?:item|noindent|newline|newpage|par|hline|ldots|dots|maketitle|tableofcontents|centering|bigskip|medskip|smallskip)\b|[\[\]()](?=[\s\S])|\\(?=\s*$))", re.M)
_TEX_MATH = re.compile(r"(?<![\\$\w])\$(?=[^\s$])(?=[^$\n]*[\\^_{])[^$\n]+?(?<=[^\s\\])\$(?![\d$])|\$\$[^$]+\$\$")
_PATH = re.compile(r"\b[A-Za-z]:\\")

LANGUAGES = ("html", "markdown", "wiki", "latex")


def _html_residue(text: str) -> bool:
    if "<" in text and (_TAG.search(text) or _COMMENT.search(text)):
        return True
    if "&" in text:
        for m in _REFERENCE.finditer(text):
            if m.group(1) is None or m.group(1) + ";" in html5:
                return True
    return False


def _markdown_residue(text: str) -> bool:
    if "`" in text and (_FENCE.search(text) or _TICK.search(text)):
        return True
    if "#" in text and _HEADING.search(text):
        return True
    if "](" in text and _LINK.search(text):
        return True
    if "]: " in text and _LINK.search(text) and "://" in text:
        return True
    if "*" in text and (_STRONG.search(text) or _STRONG_CJK.search(text)):
        return True
    if "~~" in text and _STRIKE.search(text):
        return True
    if "_" in text:
        for m in _UNDER.finditer(text):
            if not _SHOUT.match(m.group()):
                return True
    if "|" in text and _RULE.search(text):
        return True
    if ">" in text and _QUOTE.search(text):
        return True
    return bool(_BULLET.search(text))


def _wiki_residue(text: str) -> bool:
    return bool(
        ("[[" in text and _WIKI_LINK.search(text))
        or ("''" in text and _WIKI_QUOTES.search(text))
        or ("==" in text and _WIKI_HEADING.search(text))
        or ("{{" in text and _WIKI_TEMPLATE.search(text))
        or ("|" in text and ("{|" in text or "|}" in text or "||" in text or "|-" in text) and _WIKI_TABLE.search(_RULE.sub("", text)))
    )


def _latex_residue(text: str) -> bool:
    if "\\" in text:
        for m in _TEX_COMMAND.finditer(text):
            if not (m.start() and text[m.start() - 1] == ":" and _PATH.match(text, m.start() - 2)):
                return True
    return "$" in text and _TEX_MATH.search(text) is not None


_ANY = re.compile(r"[<&`#\[*~_|>{$\\=]|''|^[ \t]*[+-][ \t]", re.M)


def languages(text: str) -> list[str]:
    """The markup languages of which a plain text holds residue."""
    if not _ANY.search(text):
        return []
    tests = (_html_residue, _markdown_residue, _wiki_residue, _latex_residue)
    return [name for name, test in zip(LANGUAGES, tests, strict=True) if test(text)]


# ---- conversion to clean text that keeps structure -------------------------------------------------------------------

_TEX_WRAP = re.compile(r"\\(?:emph|textbf|textit|texttt|textsc|underline|text|mbox|uline)\{([^{}]*)\}")
_TEX_HEAD = re.compile(r"^[ \t]*\\(part|chapter|section|subsection|subsubsection)\*?\{([^{}\n]*)\}[ \t]*$", re.M)
_LEVEL = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4}


def clean(text: str) -> str:
    """Text without markup signs whose headings ("# "), lists ("- "), code (fenced), tables (" | ") and formulas (kept
    as written between $) still show. A text without markup comes back as it is."""
    kinds = languages(text)
    if not kinds:
        return text
    kept: list[str] = []

    def keep(value: str) -> str:
        kept.append(value)
        return f"\ue000{len(kept) - 1}\ue001"

    if "markdown" in kinds:
        text = re.sub(r"^[ \t]*(?:```|~~~)[\w+-]*[ \t]*\n.*?^[ \t]*(?:```|~~~)[ \t]*$", lambda m: keep(m.group()), text, flags=re.M | re.S)
    if "latex" in kinds:
        text = re.sub(r"\\begin\{(verbatim|lstlisting)\}(.*?)\\end\{\1\}", lambda m: keep("```\n" + m[2].strip("\n") + "\n```"), text, flags=re.S)
        text = re.sub(r"\\\[(.*?)\\\]|\\begin\{(?:equation|align)\*?\}(.*?)\\end\{(?:equation|align)\*?\}", lambda m: keep("$" + (m[1] or m[2]).strip() + "$"), text, flags=re.S)
        text = _TEX_MATH.sub(lambda m: keep("$" + m.group().strip("$") + "$"), text)
        text = _TEX_HEAD.sub(lambda m: "#" * _LEVEL[m[1]] + " " + m[2], text)
        text = re.sub(r"\\footnote\{([^{}]*)\}", r" (\1)", text)
        for _ in range(4):
            text = _TEX_WRAP.sub(r"\1", text)
        text = re.sub(r"^[ \t]*\\item(?:\[[^\]\n]*\])?[ \t]*", "- ", text, flags=re.M)
        text = re.sub(r"^[ \t]*\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]\n]*\])?[ \t]*\n?", "", text, flags=re.M)
        text = re.sub(r"\\(?:begin|end)\{[^{}\n]*\}|\\(?:noindent|newline|newpage|par|centering|bigskip|medskip|smallskip)\b ?", "", text)
        text = re.sub(r"\\(?:ldots|dots)\b(?:\{\})?", "…", text)
        text = re.sub(r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", text)
        text = re.sub(r"(?<=\w|\.)~(?=\w)", " ", text)
    if "html" in kinds:
        text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "", text)
        text = _COMMENT.sub("", text)
        text = re.sub(r"(?is)<pre\b[^>]*>(.*?)</pre>", lambda m: keep("```\n" + _html.unescape(re.sub(r"<[^>]*>", "", m[1])).strip("\n") + "\n```"), text)
        text = re.sub(r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1>", lambda m: "#" * int(m[1]) + " " + m[2].strip(), text)
        text = re.sub(r"(?i)<li\b[^>]*>[ \t]*", "- ", text)
        text = re.sub(r"(?i)</t[dh]>\s*<t[dh]\b[^>]*>", " | ", text)
        text = re.sub(r"(?i)<br\s*/?>[ \t]*", "\n", text)
        text = _TAG.sub("", text)
        text = _html.unescape(text)
    if "wiki" in kinds:
        text = re.sub(r"\[\[(?:File|Image|Datei|Fichier|Archivo|Файл):[^\[\]\n|]*(?:\|[^\[\]\n|]*)*?\|?([^\[\]\n|]*)\]\]", r"[\1]", text)
        text = re.sub(r"\[\[(?![+*~$%!{])(?:[^\[\]\n|]*\|)?([^\[\]\n|]+)\]\]", r"\1", text)
        text = _WIKI_HEADING.sub(lambda m: "#" * len(m[1]) + " " + m.group().strip().strip("=").strip(), text)
        text = re.sub(r"\{\{(?:Quote|Zitat|Citation|Cita)\|([^{}]*)\}\}", r"\1", text, flags=re.I)
        text = re.sub(r"\{\{(?![#/^{+*~$%!])[^{}\n|]{1,60}\|[^{}\n]*\}\}", "", text)
        text = re.sub(r"^[ \t]*(?:\{\|[^\n]*|\|\}|\|-+)[ \t]*\n?", "", text, flags=re.M)
        text = re.sub(r"^[ \t]*[|!](?![|-])[ \t]*([^\n]*)$", lambda m: re.sub(r"[ \t]*(?:\|\||!!)[ \t]*", " | ", m[1]), text, flags=re.M)
        text = re.sub(r"'{2,5}", "", text)
    if "markdown" in kinds:
        text = re.sub(r"!\[([^\[\]\n]*)\]\([^()\n]*\)", r"[\1]", text)
        text = re.sub(r"\[([^\[\]\n]*)\]\([^()\n]*\)", r"\1", text)
        text = re.sub(_RULE.pattern + r"\n?", "", text, flags=re.M)
        text = re.sub(r"^[ \t]*\|(.*)\|[ \t]*$", lambda m: " | ".join(c.strip() for c in m[1].split("|")), text, flags=re.M)
        text = re.sub(r"^[ \t]*[*+-][ \t]+(?![*+-](?:\s|$))(?=\S)", "- ", text, flags=re.M)
        text = re.sub(r"^[ \t]{0,3}>[ \t]?(?=\S)", "", text, flags=re.M)
        for _ in range(3):
            text = re.sub(r"(?<![*\\])(\*{1,3})(?=[^\s*])([^*\n]+?)(?<=[^\s*])\1(?!\*)", r"\2", text)
        text = _UNDER.sub(lambda m: m.group() if _SHOUT.match(m.group()) else m.group().strip("_"), text)
        text = re.sub(r"~~(?=[^\s~])([^~\n]+?)(?<=[^\s~])~~", r"\1", text)
        text = re.sub(r"(?<!`)`([^`\n]+)`(?!`)", r"\1", text)
    for _ in range(2):
        text = re.sub("\ue000(\\d+)\ue001", lambda m: kept[int(m[1])], text)
    return re.sub(r"\n{3,}", "\n\n", text)


# ---- wrappers ---------------------------------------------------------------------------------------------------------

_INNER = frozenset("p li h1 h2 h3 h4 h5 h6 tr td th a button small blockquote".split())


class Node:
    """A group of a wrapper: a start tag, whether optional and repeated, the text its slots held, its groups in order."""

    __slots__ = ("sign", "pages", "times", "chars", "links", "optional", "repeated", "groups")

    def __init__(self, sign: str, pages: int = 1):
        self.sign, self.pages, self.times = sign, pages, 0
        self.chars = self.links = 0
        self.optional = self.repeated = False
        self.groups: list[Node] = []

    def dump(self) -> list:
        return [self.sign, self.pages, self.times, self.chars, self.links, int(self.optional), int(self.repeated), [g.dump() for g in self.groups]]

    @staticmethod
    def load(x: list) -> Node:
        n = Node(x[0], x[1])
        n.times, n.chars, n.links, n.optional, n.repeated = x[2], x[3], x[4], bool(x[5]), bool(x[6])
        n.groups = [Node.load(g) for g in x[7]]
        return n

    def expression(self) -> str:
        """The wrapper as a union-free regular expression; #TEXT is a slot."""
        inner = " ".join(g.expression() for g in self.groups)
        body = f"<{self.sign}>" + (" #TEXT" if self.chars else "") + (" " + inner if inner else "")
        sign = "+" * self.repeated + "?" * self.optional
        return f"({body}){sign}" if sign or inner else body


def _sign(step: tuple[str, str]) -> str:
    return f"{step[0]}.{step[1]}" if step[1] else step[0]


def wrapper_of(page: Page) -> Node:
    """One page as a wrapper: repeated neighbours with the same start tag are folded into one repeated group."""
    root = Node("body")
    open_path: list[tuple[tuple[str, str], Node]] = []
    for b in page.blocks:
        path = [p for p in b.path if p[0] not in ("html", "body")]
        k = 0
        while k < len(open_path) and k < len(path) and open_path[k][0] == path[k] and not (k == len(path) - 1 and path[k][0] in _INNER):
            k += 1
        del open_path[k:]
        for step in path[k:]:
            above = open_path[-1][1] if open_path else root
            sign = _sign(step)
            if above.groups and above.groups[-1].sign == sign:
                node = above.groups[-1]
                node.repeated = True
            else:
                node = next((g for g in above.groups if g.sign == sign and step[0] in _INNER), None)
                if node is None:
                    node = Node(sign)
                    above.groups.append(node)
                else:
                    node.repeated = True
            open_path.append((step, node))
        node = open_path[-1][1] if open_path else root
        node.times += 1
        node.chars += len(b.text)
        node.links += b.links
    return root


def align(a: Node, b: Node) -> Node:
    """The least wrapper that covers both: equal groups are matched in order, all others become optional."""
    out = Node(a.sign, a.pages + b.pages)
    out.times, out.chars, out.links = a.times + b.times, a.chars + b.chars, a.links + b.links
    out.optional, out.repeated = a.optional or b.optional, a.repeated or b.repeated
    x, y = [g.sign for g in a.groups], [g.sign for g in b.groups]
    if x == y:
        out.groups = [align(p, q) for p, q in zip(a.groups, b.groups, strict=True)]
        return out
    matcher = difflib.SequenceMatcher(None, x, y, autojunk=False)
    merged: list[Node] = []
    for op, i1, i2, j1, j2 in matcher.get_opcodes():
        if op == "equal":
            merged += [align(p, q) for p, q in zip(a.groups[i1:i2], b.groups[j1:j2], strict=True)]
        else:
            merged += [_optional(g) for g in a.groups[i1:i2]] + [_optional(g) for g in b.groups[j1:j2]]
    # a group may have moved: a start tag stands once, so the wrapper stays as large as the site's vocabulary
    seen: dict[str, Node] = {}
    for g in merged:
        if g.sign in seen:
            k = next(k for k, h in enumerate(out.groups) if h.sign == g.sign)
            joined = align(out.groups[k], g)
            joined.optional = True
            out.groups[k] = seen[g.sign] = joined
        else:
            seen[g.sign] = g
            out.groups.append(g)
    return out


def _optional(node: Node) -> Node:
    node.optional = True
    return node


_STEP = " > "


def body_regions(wrapper: Node) -> list[str]:
    """Groups of a site's wrapper right below its frame, as paths from the root, from the one whose slots hold most text a
    page outside links, best first."""
    top, path = wrapper, []
    while len(top.groups) == 1 and top.groups[0].sign.split(".")[0] in ("table", "tr", "tbody", "div") and not top.groups[0].repeated:
        top = top.groups[0]
        path.append(top.sign)

    def plain(n: Node) -> int:
        return n.chars - n.links + sum(plain(g) for g in n.groups)

    ranked = sorted(top.groups, key=lambda g: -plain(g) / max(1, g.pages))
    return [_STEP.join([*path, g.sign]) for g in ranked]


def body_blocks(page: Page, regions: list[str] | None) -> list[Block]:
    """The blocks of a page's main body: the page is matched against its site's wrapper from the root down, and the slots
    below the best group it has are its body. A page that the wrapper's frame does not fit is all body."""
    if not regions:
        return page.blocks
    depth = {r: r.count(_STEP) + 1 for r in regions}
    by: dict[str, list[Block]] = {}
    for b in page.blocks:
        signs = [_sign(p) for p in b.path if p[0] not in ("html", "body")]
        for n in set(depth.values()):
            by.setdefault(_STEP.join(signs[:n]), []).append(b)
    return next((by[r] for r in regions if r in by), page.blocks)


def _fold_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, html) -> one partial wrapper per site and batch."""
    for batch in batches:
        wrappers: dict[str, Node] = {}
        for site, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            one = wrapper_of(parse(html))
            wrappers[site] = align(wrappers[site], one) if site in wrappers else one
        rows = [(s, json.dumps(w.dump())) for s, w in wrappers.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["site", "wrapper"])


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    total: Node | None = None
    for w in sorted(pdf["wrapper"]):
        node = Node.load(json.loads(w))
        total = node if total is None else align(total, node)
    return pd.DataFrame({"site": [pdf["site"].iloc[0]], "pages": [total.pages], "regions": [body_regions(total)], "wrapper": [total.expression()]})


def wrappers(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(site, pages, regions, wrapper): each site's wrapper, inferred from all its pages.

    Pages are aligned within each batch first; what is exchanged is one partial wrapper per site and batch, whose size
    follows the site's start tags and not its pages, so a site with a third of all pages is no heavier than another.
    """
    chosen = pages.select(site_key(F.col(url_col)).alias("site"), F.col(html_col).alias("html")).where("site is not null and html is not null")
    partial = chosen.mapInArrow(_fold_pages, "site string, wrapper string")
    return partial.groupBy("site").applyInPandas(_merge, "site string, pages long, regions array<string>, wrapper string")


def page_text(page: Page, regions: list[str] | None) -> str:
    """Visible text of the main body, one block a line, without what stands in code."""
    return "\n".join(b.text for b in body_blocks(page, regions) if not b.code)


def _emit(src: str, rec: list[int], markup: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([src] * len(rec), pa.string()), pa.array(rec, pa.int64()), pa.array(markup, pa.string())], names=["src", "rec_id", "markup"])


def _content_markup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rec, markup = [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = languages(text)
            rec += [i] * len(found)
            markup += found
        yield _emit("pipeline_contexts", rec, markup)


def _page_markup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rec, markup = [], []
        for i, html, regions in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = languages(page_text(parse(html), regions))
            rec += [i] * len(found)
            markup += found
        yield _emit("raw_documents", rec, markup)


def _regions(raw: DataFrame) -> DataFrame:
    """(site, regions): a short list of names per site, broadcast where the number of sites is checked to be small, so
    pages need not be exchanged; beyond that the join shuffles."""
    return sized_broadcast(wrappers(raw, "source_url", "html").select("site", "regions"), "p3-sites", most_rows=50_000)


def markup_residue(contexts: DataFrame, raw: DataFrame) -> DataFrame:
    """(src, rec_id, markup): records whose content, or whose page's main body as a browser shows it, holds markup.

    The main body of a web page comes from its site's wrapper; a book chapter is all body. Null texts give no rows, a
    repeated row gives its rows again.
    """
    schema = "src string, rec_id long, markup string"
    one = contexts.select(F.col("ctx_id").cast("long").alias("id"), F.col("content").alias("text")).where("text is not null")
    pages = raw.where("html is not null").select(F.col("raw_id").cast("long").alias("id"), "html", site_key(F.col("source_url")).alias("site"))
    two = pages.join(_regions(raw), "site", "left").select("id", "html", "regions")
    return one.mapInArrow(_content_markup, schema).unionByName(two.mapInArrow(_page_markup, schema))


def clean_texts(contexts: DataFrame, raw: DataFrame) -> DataFrame:
    """(src, rec_id, clean_text): every record's text without markup, its structure kept. Null stays null."""

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if t is None else clean(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(["pipeline_contexts"] * len(out), pa.string()), batch.column(0), pa.array(out, pa.string())], names=["src", "rec_id", "clean_text"])

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, html, regions in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append(None if html is None else structured(body_blocks(parse(html), regions)))
            yield pa.RecordBatch.from_arrays([pa.array(["raw_documents"] * len(out), pa.string()), batch.column(0), pa.array(out, pa.string())], names=["src", "rec_id", "clean_text"])

    schema = "src string, rec_id long, clean_text string"
    one = contexts.select(F.col("ctx_id").cast("long").alias("id"), "content")
    chosen = raw.select(F.col("raw_id").cast("long").alias("id"), "html", site_key(F.col("source_url")).alias("site"))
    two = chosen.join(_regions(raw), "site", "left").select("id", "html", "regions")
    return one.mapInArrow(contents, schema).unionByName(two.mapInArrow(pages, schema))


def structured(blocks: list[Block]) -> str:
    """Blocks as clean text: headings, lists, table rows and code keep a sign of what they are."""
    out: list[str] = []
    code = False
    row: list[str] = []

    def end_row() -> None:
        if row:
            out.append(" | ".join(row))
            row.clear()

    last_line = None
    for b in blocks:
        tags = [t for t, _ in b.path]
        leaf = tags[-1] if tags else ""
        if b.code != code:
            end_row()
            out.append("```")
            code = b.code
        if b.code:
            out.append(b.text)
            continue
        text = clean(b.text)
        if leaf in ("td", "th") and "tr" in tags and len(b.text) < 80:
            if b.line != last_line:
                end_row()
            row.append(text)
            last_line = b.line
            continue
        end_row()
        if leaf in ("h1", "h2", "h3", "h4", "h5", "h6"):
            text = "#" * int(leaf[1]) + " " + text
        elif leaf == "li":
            text = "- " + text
        out.append(text)
    end_row()
    if code:
        out.append("```")
    return "\n".join(out)
