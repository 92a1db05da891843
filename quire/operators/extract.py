"""Pages to candidates for content, title and next link in one parse; the choice between them is a Catalyst expression."""

from __future__ import annotations

import json
import math
import re
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import urls
from quire.functions.text import normalize_title, strip, strip_site_suffix, tag_title
from quire.operators.dom import Element, Markdown, Measure, filtered, first, plain_text, select, tree
from quire.operators.shared import with_python_column

# Fixed values of the task.
FALLBACK = [
    "#chapter-c", "#chr-content", "div.chapter-content", ".chapter-content", "article", "[itemprop='articleBody']", "#storytext", "div.text-left",
    "div.entry-content",
]
NOT_TITLES = ("select", "option", "nav", "ul", "ol", "table", "tbody")
TITLE_BANNED = [
    "comment", "comments", "review", "reviews", "rating", "ratings", "sidebar", "footer", "related", "recommendation", "recommendations",
    "discussion", "feedback", "social", "share", "ads", "advert",
]
NEXT_TEXT = (
    r"(?iU)\b(next|tiếp|sau|next\s*chapter|chương\s*tiếp|siguiente)\b|下一[章页節话話节回]|下章|下页|下節|下一篇|次[へのページ章話]|次のページ"
    r"|つぎへ|つぎのページ|다음[\s ]*(?:화|장|편|페이지)?"
)

_LINK = T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())])
_CANDIDATE = T.StructType([T.StructField("method", T.StringType()), T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType())])
PAGE = T.StructType(
    [
        T.StructField("contents", T.ArrayType(_CANDIDATE)),
        T.StructField("titles", T.ArrayType(_CANDIDATE)),
        T.StructField("title_tag", T.StringType()),
        T.StructField("og_title", T.StringType()),
        T.StructField("rel_next", T.StringType()),
        T.StructField("selector_next", T.StringType()),
        T.StructField("dropdown_next", T.StringType()),
        T.StructField("links", T.ArrayType(_LINK)),
        T.StructField("images", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
        T.StructField("parse_failed", T.BooleanType()),
    ]
)


def density(m: Measure) -> float:
    """How much of an element is running text: share of text in its markup, few links, length, paragraphs."""
    if m.text < 50 or m.links / m.text > 0.6:
        return 0.0
    return m.text / max(1, m.size) * (1 - m.links / m.text) * math.log(m.text + 1) * (1 + min(0.05 * m.paragraphs, 0.3))


def _json_ld(html: str) -> str | None:
    for m in re.finditer(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", html):
        try:
            data = json.loads(m[1])
        except ValueError:
            continue
        for x in data if isinstance(data, list) else [data]:
            if isinstance(x, dict) and str(x.get("@type", "")) in ("Article", "BlogPosting", "NewsArticle", "WebPage", "Chapter", "Book", "CreativeWork"):
                for key in ("articleBody", "text", "description"):
                    if isinstance(x.get(key), str) and len(x[key].strip()) >= 150:
                        return x[key].strip()
    return None


def read_page(html: str | None, url: str | None, content_selector: str | None, title_selector: str | None, next_selector: str | None, remove: list | None, rules: dict | None) -> dict:
    """All candidates of one page. Nulls and broken pages give empty candidates, never an error."""
    out: dict = {"contents": [], "titles": [], "links": [], "images": [], "parse_failed": False}
    out |= dict.fromkeys(("title_tag", "og_title", "rel_next", "selector_next", "dropdown_next"))
    if not html:
        return out
    url = url or ""
    try:
        root = filtered(tree(html), list(remove) if remove is not None else None, [content_selector, title_selector, next_selector])
    except Exception:
        root, out["parse_failed"] = tree(""), True

    def rendered(e: Element) -> str:
        if rules is None:
            return plain_text(e)
        m = Markdown(rules, url)
        text = m.render(e)
        out["images"] = out["images"] or m.images
        return text

    def offer(method: str, e: Element | None, confidence: float, least: int = 150) -> None:
        if e is not None and len((text := rendered(e)).strip()) >= least:
            out["contents"].append({"method": method, "text": text, "confidence": confidence})

    offer("selector", first(root, content_selector), 0.95)
    if (text := _json_ld(html)) is not None and out["parse_failed"]:
        out["contents"].append({"method": "json_ld", "text": text, "confidence": 0.85})
    if not out["contents"]:
        best, score, measures = None, 0.0, root.measures()
        for e in root.all():
            if e.tag in ("article", "main", "section", "div", "td") and (m := measures[id(e)]).text >= 150 and (d := density(m)) > score:
                best, score = e, d
        offer("density", best, min(0.85, 0.4 + 0.1 * score))
    if not out["contents"]:
        for s in FALLBACK:
            offer("fallback", first(root, s), 0.7)
            if out["contents"]:
                break
    e = first(root, title_selector)
    if e is not None and e.tag not in NOT_TITLES and 3 <= len(t := e.text(" ")) <= 200:
        out["titles"].append({"method": "selector", "text": t, "confidence": 0.95})
    heads: dict[str, str] = {}
    for x in root.all():
        tag = x.tag
        if tag == "a":
            if href := x.attrs.get("href"):
                out["links"].append({"href": href if href.startswith("#") else urljoin(url, href), "text": x.text().strip()})
        elif tag in ("h1", "h2"):
            if tag not in heads and 3 <= len(t := x.text(" ")) <= 200 and not _banned(x):
                heads[tag] = t
        elif tag == "title":
            if out["title_tag"] is None:
                out["title_tag"] = x.text().strip() or None
        elif tag == "meta" and x.attrs.get("property") == "og:title" and out["og_title"] is None:
            out["og_title"] = x.attrs.get("content")
    out["titles"] += [{"method": tag, "text": heads[tag], "confidence": 0.8} for tag in ("h1", "h2") if tag in heads]
    rel = first(root, "link[rel~=next]") or first(root, "a[rel~=next]")
    if rel is not None and rel.attrs.get("href"):
        out["rel_next"] = urljoin(url, rel.attrs["href"])
    own = first(root, next_selector)
    if own is not None:
        href = own.attrs.get("href") or next((a.attrs["href"] for a in own.all() if a.tag == "a" and a.attrs.get("href")), None)
        out["selector_next"] = urljoin(url, href) if href else None
    out["dropdown_next"] = _dropdown(root, url)
    return out


def _banned(e: Element) -> bool:
    for _ in range(10):
        if e is None:
            return False
        marks = (e.attrs.get("class", "") + " " + e.attrs.get("id", "")).lower()
        if any(w in marks for w in TITLE_BANNED):
            return True
        e = e.parent
    return False


def _dropdown(root: Element, url: str) -> str | None:
    """The option after the selected one, or after the one whose value is in the address."""
    if not any(e.tag == "select" for e in root.all()):
        return None
    for s in ("select#chapterList", "select.chapter-select", "select[name='chapter']", "select.selectpicker", "select#chapter", "select.chapter-dropdown", "select"):
        box = first(root, s)
        options = select(box, "option") if box is not None else []
        at = next((i for i, o in enumerate(options) if "selected" in o.attrs), None)
        if at is None:
            at = next((i for i, o in enumerate(options) if o.attrs.get("value") and o.attrs["value"] in url), None)
        if at is not None and at + 1 < len(options) and (value := options[at + 1].attrs.get("value", "").strip()):
            return urljoin(url, value)
    return None


def chosen(page: Column, url: Column) -> dict[str, Column]:
    """The first candidate of each chain: content, its method and confidence, title, next link and their methods."""
    content = F.try_element_at(page["contents"], F.lit(1))
    heads = F.filter(F.transform(page["titles"], lambda t: F.struct(t["method"].alias("method"), strip_site_suffix(normalize_title(t["text"])).alias("text"))), lambda t: F.length(t["text"]) >= 3)
    head = F.try_element_at(heads, F.lit(1))
    tag, og = tag_title(page["title_tag"]), tag_title(page["og_title"])
    title = F.coalesce(head["text"], F.when(F.length(tag) >= 3, tag), F.when(F.length(og) >= 3, og), urls.title_from_slug(url))
    linked = F.try_element_at(F.filter(page["links"], lambda x: x["text"].rlike(NEXT_TEXT) & ~x["href"].startswith("#")), F.lit(1))["href"]
    chain = [("rel_next", page["rel_next"]), ("selector", page["selector_next"]), ("anchor_text", linked), ("slug", urls.next_by_slug(url)), ("story", urls.next_by_story(url))]
    method = F.coalesce(*(F.when(c.isNotNull(), F.lit(n)) for n, c in chain))
    return {
        "content": content["text"],
        "content_method": content["method"],
        "content_confidence": content["confidence"],
        "title": title,
        "next_url": F.coalesce(*(c for _, c in chain)),
        "next_method": method,
    }


def chapter_links(page: Column, most: int | None = None) -> Column:
    """Addresses of chapters a page links to, each once, in order; by their text where no address tells."""
    by_url = F.array_distinct(F.transform(F.filter(page["links"], lambda x: x["href"].rlike(urls.CHAPTER)), lambda x: x["href"]))
    by_text = F.array_distinct(F.transform(F.filter(page["links"], lambda x: x["text"].rlike(r"(?i)\b(?:chapter|chap|chương|episode|ep|part)\s*0*1\b")), lambda x: x["href"]))
    out = F.when(F.size(by_url) > 0, by_url).otherwise(by_text)
    return out if most is None else F.slice(out, 1, most)


def with_candidates(df: DataFrame, html: str, url: str, profile: dict[str, str] | None = None) -> DataFrame:
    """`df` with a struct column `page`. `profile` names the columns of a site's selectors; absent ones are null."""
    p = profile or {}
    keys = ("content", "title", "next", "remove", "rules")
    for k in keys:
        df = df.withColumn(f"__{k}", F.col(p[k]) if k in p else F.lit("{}" if k == "rules" else None).cast("array<string>" if k == "remove" else "string"))
    inputs = [html, url, *(f"__{k}" for k in keys)]
    read = lambda h, u, c, t, n, r, j: read_page(h, u, c, t, n, r, json.loads(j) if j else None)
    return with_python_column(df, inputs, "page", PAGE, read).drop(*(f"__{k}" for k in keys))


def body_of(content: Column, title: Column) -> Column:
    """Content without a first line that repeats the title."""
    first_line = F.substring_index(content, "\n", 1)
    same = F.lower(strip(F.regexp_replace(strip(first_line), "^#+", ""))) == F.lower(strip(title))
    return F.when(F.coalesce(same, F.lit(False)), strip(F.substr(content, F.length(first_line) + 2))).otherwise(content)
