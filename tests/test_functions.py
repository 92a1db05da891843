import hashlib

import pytest

from quire.functions import text as X
from quire.functions import urls as U


@pytest.mark.parametrize(
    "url, slug, kind, prefix",
    [
        ("https://a.com/chapter-5", "https://a.com/chapter-6", "chapter", None),
        ("https://a.com/novel/x-1/c0004/?p=1", "https://a.com/novel/x-1/c5/?p=1", "index", None),
        ("https://royalroad.com/fiction/55418/the-inn", None, "index", "/fiction/55418/"),
        ("https://x.com/read/1539267-the-wanderer/chapter/1539274/", None, "chapter", "/read/1539267"),
        ("https://fanfiction.net/s/123/9/Story", None, "chapter", "/s/123/"),
        ("nonsense", None, "other", None),
    ],
)
def test_addresses(one, url, slug, kind, prefix):
    assert one(U.next_by_slug, u=url) == slug
    assert one(U.page_type, u=url) == kind
    assert one(U.story_prefix, u=url) == prefix


def test_next_by_story_and_site(one):
    assert one(U.next_by_story, u="https://fanfiction.net/s/123/9/Story") == "https://fanfiction.net/s/123/10/Story"
    assert one(U.site_key, u="HTTPS://user@WWW.Site.example:80/x") == "site.example"
    assert one(U.site_key, u="http://m.site.example") == "site.example"
    assert one(U.site_key, u=None) is None
    assert one(U.domain_tag, u="https://www.scribblehubxyz.com/a") == "scribblehubx"
    assert one(U.title_from_slug, u="https://a.com/fiction/55418/the-wandering-inn") == "The Wandering Inn"
    assert one(U.title_from_slug, u="C:/books/x.epub") is None
    assert one(U.output_dir, u="https://www.a.com/x/y/z") == "a.com/x/y"


def test_titles(one):
    assert one(lambda t: X.strip_site_suffix(t), t="Chapter 5 [1,234 words] | NovelFire") == "Chapter 5"
    assert one(X.tag_title, t="Chapter 5 - Royal Road") == "Chapter 5 - Royal Road"
    assert one(X.tag_title, t="Rock Falls | Royal Road") == "Rock Falls"
    assert one(X.story_title, t="Chapter 5 – The Rise | Rock Falls | Royal Road") == "Rock Falls"
    assert one(X.story_title, t="Chapter 5 | ao3") is None
    assert one(X.normalize_title, t="  The \t Hunter- ") == "The Hunter"
    assert one(X.normalize_title, t=None) == ""


def test_lines_and_fingerprint(one):
    assert one(X.lines, t="a\r\nb\n\nc\n") == ["a", "b", "", "c"]
    assert one(X.lines, t="") == []
    want = hashlib.md5(b"a b c").hexdigest()[:16]
    assert one(X.fingerprint, t=" a\u00a0b\n\n c ") == want
    assert one(X.fingerprint, t=None) is None
    assert one(lambda t: X.truncate(t, 4), t="abcdef") == "abc…"


def test_page_predicates(spark):
    from pyspark.sql import functions as F

    long = "<html>" + "x" * 300
    rows = [(long, 200), (long, 404), (long, 429), (None, 200), ("<title>Page Not Found</title>" + "x" * 300, 200), ("<title>Just a moment...</title>" + "x" * 200, 200)]
    df = spark.createDataFrame(rows, "html string, status int")
    got = df.select(X.is_junk_page(F.col("html"), F.col("status")), X.is_challenge(F.col("html"))).collect()
    assert [r[0] for r in got] == [False, True, False, True, True, False]
    assert [r[1] for r in got] == [False, False, False, False, False, True]


def prose(text):
    import re

    words = re.findall(r"\w+", text)
    n = len(words)
    sents = [s for s in re.split("[.!?。！？]+", text) if s.strip()]
    rows = [x for x in text.splitlines() if x.strip()]
    mean = n / len(sents) if sents else 0
    parts = [n / 20 * 0.5 if n < 20 else min(1, n / 200)]
    parts.append(0.3 if not sents else mean / 5 if mean < 5 else 1.0 if mean <= 50 else max(0.3, 1 - (mean - 50) / 100))
    parts.append(min(1, (text.count("\n\n") + 1) / max(len(rows) / 3, 1)))
    parts.append(max(0, 1 - 3 * sum(re.match(r"^[A-Z\s\d\W]{5,}$", x) is not None for x in rows) / max(len(rows), 1)))
    parts.append(min(1, len({w.lower() for w in words}) / n * 1.5) if n else 0)
    return sum(parts) / 5


@pytest.mark.parametrize("text", ["One two three. Four five!", "ALL CAPS HERE\nmore text follows here.\n\n" * 9, "слово " * 60 + ".", "一二三。四五六！", "...", "word " * 400])
def test_prose_score(one, text):
    assert one(X.prose_score, t=text) == pytest.approx(prose(text.strip()), abs=6e-4)


@pytest.mark.parametrize(
    "kw, ok",
    [("support the author on our site", True), ("short", False), ("<b>some markup here</b>", False), ("see https://x.example now", False), ("next chapter", False), ("advertisement", False), ("a b c d e f g h i j k l", False)],
)
def test_keywords(one, kw, ok):
    assert one(X.is_keyword, k=kw) is ok


@pytest.mark.parametrize(
    "md, plain",
    [("***triple***", "triple"), ("5 * 3 = 15", "5 * 3 = 15"), ("code_name", "code_name"), ("**bold *it* x**", "bold it x"), ("[a](u) ![b](v)", "a [IMAGE: b]"), ("# H\n> q", "H\nq")],
)
def test_markdown(one, md, plain):
    assert one(X.strip_markdown, m=md) == plain
