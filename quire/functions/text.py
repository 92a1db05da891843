"""Text logic as Catalyst expressions: predicates, scores and rewrites of titles, lines and keywords."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"[\s\u001C-\u001F\u0085   -     　]"


def let(value: Column, body) -> Column:
    """`body` applied to a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without Unicode blanks at both ends."""
    return F.regexp_replace(c, f"^{_WS}+|{_WS}+$", "")


def collapse(c: Column) -> Column:
    """Every run of Unicode blanks as one space."""
    return F.regexp_replace(c, f"{_WS}+", " ")


def lines(c: Column) -> Column:
    """Lines as Python's splitlines gives them: no empty line after a final line break; '' has none."""
    parts = F.split(c, "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]", -1)
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def any_match(c: Column, patterns: list[str]) -> Column:
    """Whether one of the Java regular expressions is found."""
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def truncate(c: Column, n: int, ellipsis: str = "…") -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - len(ellipsis)), F.lit(ellipsis)))


def fingerprint(c: Column) -> Column:
    """First 16 hex digits of the md5 of the text with blanks collapsed; null for null."""
    return F.substring(F.md5(collapse(strip(c)).cast("binary")), 1, 16)


# ---- page predicates --------------------------------------------------------------------------------------------------

# Fixed values of the task.
JUNK_STATUS = [400, 401, 403, 404, 410, 500, 502, 503, 504]
JUNK_TITLES = ["404", "not found", "error", "access denied", "forbidden"]
CHALLENGE = [
    "<title>[^<]*just a moment[^<]*</title>", "<title>[^<]*cloudflare[^<]*</title>", "cf-browser-verification", "checking your browser",
    "enable javascript and cookies", "ray id.*cloudflare", 'id="challenge-form"', "__cf_chl_opt",
]


def is_junk_page(html: Column, status: Column) -> Column:
    """Null or short page, a permanent error status, or an error in the title; 429 is no junk, it is retried."""
    bad_title = any_match(F.substring(html, 1, 2000), [f"(?i)<title>[^<]*{t}[^<]*</title>" for t in JUNK_TITLES])
    short = html.isNull() | (F.length(strip(html)) < 200)
    return F.when(short, True).when(F.coalesce(status, F.lit(200)).isin(JUNK_STATUS), True).otherwise(bad_title)


def is_challenge(html: Column) -> Column:
    found = any_match(F.substring(html, 1, 5000), [f"(?i){p}" for p in CHALLENGE])
    return F.when(html.isNull() | (F.length(html) < 100), False).otherwise(found)


# ---- validation -------------------------------------------------------------------------------------------------------


def length_score(content: Column, least: int = 100) -> Column:
    """struct(valid, score): at least `least` characters; min(1, characters / 2000)."""
    n = F.length(strip(F.coalesce(content, F.lit(""))))
    return F.struct((n >= least).alias("valid"), F.least(F.lit(1.0), n / F.lit(2000.0)).alias("score"))


_WORD = r"[\p{L}\p{N}_]+"


def prose_score(content: Column, least_words: int = 20) -> Column:
    """Mean of five scores of a text: words, sentence length, paragraphs, lines in capitals, distinct words; 3 places."""
    words = let(F.regexp_extract_all(strip(content), F.lit(_WORD), F.lit(0)), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(F.transform(w, F.lower))).alias("kinds")))
    sentences = F.size(F.filter(F.split(strip(content), "[.!?。！？]+", -1), lambda s: F.length(strip(s)) > 0))
    rows = let(
        F.filter(lines(strip(content)), lambda x: F.length(strip(x)) > 0),
        lambda r: F.struct(F.size(r).alias("n"), F.size(F.filter(r, lambda x: x.rlike(r"^(?:[A-Z]|[^\p{L}\p{N}_]|\p{Nd}){5,}$"))).alias("capitals")),
    )
    gaps = (F.length(strip(content)) - F.length(F.replace(strip(content), F.lit("\n\n"), F.lit("")))) / 2
    facts = F.struct(words.alias("w"), sentences.alias("s"), rows.alias("r"), gaps.alias("g"))

    def score(x: Column) -> Column:
        n, m = x["w"]["n"], x["r"]["n"]
        count = F.when(n < least_words, n / F.lit(least_words) * 0.5).otherwise(F.least(F.lit(1.0), n / F.lit(200)))
        mean = n / x["s"]
        sentence = (
            F.when(x["s"] == 0, F.lit(0.3))
            .when(mean < 5, mean / 5)
            .when(mean <= 50, F.lit(1.0))
            .otherwise(F.greatest(F.lit(0.3), F.lit(1.0) - (mean - 50) / 100))
        )
        paragraph = F.least(F.lit(1.0), (x["g"] + 1) / F.greatest(m / F.lit(3.0), F.lit(1.0)))
        capital = F.greatest(F.lit(0.0), F.lit(1.0) - x["r"]["capitals"] / F.greatest(m, F.lit(1)) * 3)
        distinct = F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), x["w"]["kinds"] / n * 1.5))
        return F.round((count + sentence + paragraph + capital + distinct) / 5, 3)

    return let(facts, score)


# ---- titles -----------------------------------------------------------------------------------------------------------

# Fixed values of the task: names of sites that end page titles.
SITES = [
    r"royal\s*road", r"scribble\s*hub", "wattpad", r"fanfiction(?:\.net)?", r"archiveofourown(?:\.org)?", "ao3", "webnovel", "novelfire",
    "novelupdates", "lightnovelreader", "novelfull", "wuxiaworld", "readlightnovel", r"fandom(?:\.com)?", r"[a-z0-9\-]+\.(?:com|net|org|io)",
]
KNOWN_SITES = [
    "royalroad", "royal road", "scribblehub", "wattpad", "fanfiction", "fanfiction.net", "archiveofourown", "ao3", "webnovel", "novelfire",
    "novelupdates", "lightnovelreader", "novelfull", "wuxiaworld",
]


def normalize_title(c: Column) -> Column:
    """Without control characters, blanks collapsed, no dash at the end; null gives ''."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\u0000-\u001f\u007f]", "")
    return strip(F.regexp_replace(strip(F.regexp_replace(plain, r"[ \t]+", " ")), r"[\-–—]+\s*$", ""))


def strip_site_suffix(c: Column) -> Column:
    """Without the site's name, a fan-fiction descriptor and a word count at the end, in this order."""
    c = strip(F.regexp_replace(c, r"(?i)\s*[\|–—\-]\s*(?:" + "|".join(SITES) + r")\s*$", ""))
    c = strip(F.regexp_replace(c, r"(?i),\s*a\s+.{3,80}?\s+fanfic(?:tion)?\s*$", ""))
    return strip(F.regexp_replace(c, r"(?i)\s*\[\s*[\d,.\s]*\.?\s*words?\s*\]\s*$", ""))


def tag_title(raw: Column) -> Column:
    """Title of a title tag: the suffix goes only where a pipe or a long dash announces it."""
    plain = normalize_title(raw)
    return F.when(raw.rlike(r"[|–—]"), strip_site_suffix(plain)).otherwise(plain)


def story_title(raw: Column) -> Column:
    """Longest part of a page title that is no chapter, no known site and has three characters; the first of equals."""
    parts = F.transform(F.split(raw, r"\s*[\|–—]\s*", -1), strip)
    kept = F.filter(
        parts,
        lambda p: (F.length(p) >= 3) & ~p.rlike(r"(?i)^\s*(?:chapter|chap|ch|episode|ep|part|chuong|phan)\b[\s.\-:]*\d*") & ~F.lower(p).isin(KNOWN_SITES),
    )
    longest = lambda k: F.array_max(F.transform(k, F.length))
    return let(kept, lambda k: F.try_element_at(F.filter(k, lambda p: F.length(p) == longest(k)), F.lit(1)))


# ---- boilerplate keywords ---------------------------------------------------------------------------------------------

# Fixed values of the task: words of the interface that are no keyword by themselves.
GENERIC = [
    "title", "novel", "login", "browse", "filter", "random", "ranking", "author", "useful", "member", "update", "follow", "share", "report",
    "search", "logout", "signup", "rating", "review", "submit", "cancel", "saving", "reader", "latest", "recent", "posted", "edited", "status",
    "advertisement",
]


def is_keyword(c: Column) -> Column:
    """Whether a text can be a boilerplate keyword: plain, 8 to 200 characters, at most ten words, no label or link."""
    s = strip(c)
    words = F.size(F.filter(F.split(s, f"{_WS}+", -1), lambda w: w != ""))
    return (
        ~s.startswith("<") & ~s.startswith("#") & ~s.contains("</") & ~s.contains("://") & F.length(s).between(8, 200)
        & ~F.lower(s).isin(GENERIC) & (words <= 10) & ~s.rlike(r"(?i)^(?:(?:next|prev(?:ious)?)\s+(?:chapter|page)|(?:fiction|chapter)\s+index)\s*$")
    )


# ---- markdown to text -------------------------------------------------------------------------------------------------


def strip_markdown(c: Column, images: str = "[IMAGE: $1]") -> Column:
    """Markdown as plain text: images become `images`, links their text; emphasis, headings and quotes lose their signs."""
    steps = [
        (r"!\[([^\]]*)\]\([^)]*\)", images),
        (r"(?<!!)\[([^\]]+)\]\([^)]*\)", "$1"),
        (r"(?s)\*\*(.+?)\*\*", "$1"),
        (r"(?s)__(.+?)__", "$1"),
        (r"(?<!\*)\*([^*\s][^*\n]*?[^*\s]|[^*\s])\*(?!\*)", "$1"),
        (r"(?<!_)_([^_\s][^_\n]*?[^_\s]|[^_\s])_(?!_)", "$1"),
        (r"(?m)^#{1,6}\s+", ""),
        (r"(?m)^>\s*", ""),
        (r"\n{3,}", "\n\n"),
    ]
    return strip(reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c))
