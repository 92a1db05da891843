import datetime as dt
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators import boilerplate, chapters, guards, lines, naming, profiles, render
from quire.operators.dom import Markdown, filtered, first, plain_text, select, tree
from quire.operators.extract import chosen, read_page, with_candidates
from quire.sources import config, files

LONG = "This line of prose has rather more than seven words in it."


def test_cleaning_passes():
    assert lines.scrubbed(None) is None
    assert lines.scrubbed("short") == "short"
    body = "\n".join([LONG] * 8)
    assert lines.scrubbed(body + "\n<script>x()</script>") == body
    assert lines.scrubbed(body + "\n\u2800\u2800\n" + LONG) == body + "\n" + LONG
    assert lines.scrubbed(body + "\nComments (3)\nnice\nthanks") == body
    assert lines.scrubbed(body + "\n## Support the author\nPatreon") == body
    panel = "\n".join(["Font size", "Font family", "Theme", "Width", "Expand", "Tighten", "3/4", "1/2"])
    # the window that finds a panel begins up to four lines before it, and the panel ends at the second other line
    assert lines.without_settings(f"{body}\n{panel}\n{LONG}\n{LONG}") == "\n".join([LONG] * 5)
    head = "By: Someone\nWords: 1,234\nUpdated: today\nStatus: ongoing"
    assert lines.scrubbed(f"{head}\n\n{body}") == body
    assert lines.scrubbed(f"{body}\nReport chapter\n{LONG}") == f"{body}\n{LONG}"
    assert lines.scrubbed(LONG * 2 + "\nComments (1)\n" * 3 + ("x\n" * 500)).startswith(LONG)


def test_status_boxes():
    text = "**HP**: 1\n\n**Mana:** 2\nFull Status:\n**Level**\nprose"
    assert lines.with_status_boxes(text) == "> [!info]+ Status\n> **HP:** 1\n>\n> **Mana:** 2\n> **Full Status**\n> **Level**\n\nprose"
    assert lines.with_status_boxes("**a**: 1\n**b**: 2\nprose") == "**a**: 1\n**b**: 2\nprose"


def test_edges():
    body = [f"{LONG} {i}" for i in range(9)]
    texts = {
        "\n".join(["Next", *body, "Next"]): "\n".join(body),
        "\n".join(["[1,234 words]", "", "Next", *body, "", "Prev"]): "\n".join(body),
        "\n".join([LONG] * 6 + ["Next"]): None,  # fewer than eight lines
        "one\ntwo": None,
        "": None,
    }
    for t, want in texts.items():
        assert lines.without_edges(t) == (want or t)


@pytest.mark.parametrize(
    "tape, left",
    [
        ("pppp" + "SSSSSSSS" + "pp", "p"),  # the window that finds the panel begins before it; the first other line goes too
        ("SSSS" + "pS_pS_" + "p_p", "p"),  # one other line between settings does not end a panel, nor do blanks
        ("SSSp" * 2, ""),
        ("pSpSpSpp", "pSpSpSpp"),  # three settings are no panel
        ("ppppSSSS" + "_" * 3, ""),
    ],
)
def test_settings_panels(tape, left):
    lead = [f"{LONG} {LONG} {i}" for i in range(9)]  # keeps the result above the least length
    row = {"S": "Font size", "p": LONG, "_": ""}
    got = lines.without_settings("\n".join([*lead, "x", *(row[t] for t in tape)])).split("\n")
    kept = [r for r in got if r in (LONG, "Font size", "")]
    assert "".join({LONG: "p", "Font size": "S", "": "_"}[r] for r in kept) == left


def test_boilerplate_of_twelve_chapters(spark):
    mark = "read this only on the home site"
    rows = [("s", f"{mark}\n" + "\n".join(f"line {i} {j} of the story goes on" for j in range(20))) for i in range(12)] + [("s", None), ("t", "")]
    docs = spark.createDataFrame(rows, "domain string, text string")
    found = boilerplate.candidates(boilerplate.suspects(docs, F.col("domain"), F.col("text"))).where("kind = 'auto'").collect()
    assert [(r.line, r.n) for r in found] == [(mark, 12)]
    words = spark.createDataFrame([("s", mark)], "domain string, keyword string")
    out = boilerplate.filter_lines(docs, F.col("domain"), "text", words).where(F.col("text").contains(mark)).count()
    assert out == 0
    short = spark.createDataFrame([("s", "alpha beta gamma\nbeta gamma delta\ngamma delta eps\ndelta eps zeta")], "domain string, text string")
    assert {r.n for r in boilerplate.suspects(short, F.col("domain"), F.col("text")).collect()} == {2}  # both edges hold each line
    merged = boilerplate.merge_keywords(words, spark.createDataFrame([("s", "another keyword"), ("s", mark)], "domain string, keyword string")).collect()
    assert merged[0].keywords == ["another keyword", mark]


def test_text_chapters(spark):
    docs = spark.createDataFrame(
        [(1, "preface\nChapter 1: Start\nbody one\n\nChapter 2\nbody two"), (2, "no chapters"), (3, None), (4, "Chương 1 - Khám phá\nx\nChương 2\ny"), (5, "")], "id long, text string"
    )
    got = {(r.id, r.chapter_index, r.title, r.body) for r in chapters.split_chapters(docs, "id", "text").collect()}
    assert got == {(1, 1, "Chapter 1: Start", "body one"), (1, 2, "Chapter 2", "body two"), (4, 1, "Chương 1 - Khám phá", "x"), (4, 2, "Chương 2", "y")}
    assert sorted(r.id for r in chapters.without_case(docs, "id", "text").collect()) == [2, 5]
    html = docs.where("id = 1").select(chapters.to_page(F.lit("T"), F.lit("a < b\nc\n\nd")).alias("h")).first().h
    assert html == "<html><body><article><h1>T</h1>\n<p>a &lt; b<br/>c</p>\n<p>d</p></article></body></html>"


def test_book_plan(spark):
    rows = [
        ("b", 0, "cover", "cover.xhtml", None), ("b", 1, "d1", "a.xhtml", "1"), ("b", 2, "d2", "a2.xhtml", None), ("b", 3, "ad", "advert.xhtml", None),
        ("b", 4, "d3", "b.xhtml", None), ("b", 5, "d4", "c.xhtml", "The End"), ("b", 6, "cr", "copyright.xhtml", None), ("b", 7, "d5", "z.xhtml", None),
    ]
    spine = spark.createDataFrame(rows, "book string, pos int, doc_id string, file string, toc_title string")
    plan = {r.chapter_index: (r.kind, r.title, r.doc_ids) for r in chapters.chapter_plan(spine).collect()}
    assert plan == {0: ("matter", "Front Matter", ["cover", "d3", "cr", "d5"]), 1: ("chapter", "Chapter 1", ["d1", "d2"]), 2: ("chapter", "The End", ["d4"])}
    toc = spark.createDataFrame([("b", 0, "OPS/A.xhtml#x", "One"), ("b", 1, "OPS/c.xhtml", "Two"), ("b", 2, "c.xhtml", "Exact")], "book string, ord int, href string, title string")
    got = {r.doc_id: r.toc_title for r in chapters.match_toc(spine.drop("toc_title"), toc).collect()}
    assert (got["d1"], got["d4"], got["cover"]) == ("One", "Exact", None)


def test_guards(spark):
    docs = spark.createDataFrame([("s", 1, "a  b"), ("s", 2, "c"), ("s", 3, "a b"), ("s", 4, "d"), ("t", 1, "a b"), ("t", 2, None)], "story string, i int, text string")
    marked = guards.duplicates(docs, "text", ["i"], ["story"])
    assert {(r.story, r.i): r.copy_no for r in marked.collect()} == {("s", 1): 1, ("s", 2): 1, ("s", 3): 2, ("s", 4): 1, ("t", 1): 1, ("t", 2): None}
    left = guards.until_repeat(marked.where("fp is not null"), "story", "i", "fp").collect()
    assert sorted((r.story, r.i) for r in left) == [("s", 1), ("s", 2), ("t", 1)]
    e = spark.createDataFrame([("d", k, s) for k, s in enumerate("ok fail fail ok fail".split())], "k string, i int, s string")
    assert [r.streak for r in guards.streaks(e, "k", ["i"], F.col("s") == "fail").orderBy("i").collect()] == [0, 1, 2, 0, 1]
    import random

    random.seed(3)
    many = spark.createDataFrame([(random.choice("ab"), k, random.random() < 0.7) for k in range(300)], "k string, i int, f boolean")
    whole = {(r.k, r.i): r.streak for r in guards.streaks(many, "k", ["i"], F.col("f")).collect()}
    for size in (1, 7, 50):
        assert {(r.k, r.i): r.streak for r in guards.streaks(many, "k", ["i"], F.col("f"), F.floor(F.col("i") / size)).collect()} == whole
    copies = spark.createDataFrame([(k, random.choice(["x", "y", None])) for k in range(200)], "i int, text string")
    ranks = {r.i: r.copy_no for r in guards.duplicates(copies, "text", ["i"]).collect()}
    assert {r.i: r.copy_no for r in guards.duplicates(copies, "text", ["i"], bucket=F.floor(F.col("i") / 9)).collect()} == ranks
    t0 = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([("u", t0), ("u", t0 + dt.timedelta(seconds=59)), ("u", t0 + dt.timedelta(seconds=60))], "u string, ts timestamp")
    assert sorted(r.recent for r in guards.trailing_count(ev, "u", "ts").collect()) == [1, 2, 2]
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", None)], "url string, next_url string")
    starts = spark.createDataFrame([("a",), ("x",)], "url string")
    assert sorted((r.start, r.step, r.url) for r in guards.walk(links, starts).collect()) == [("a", 0, "a"), ("a", 1, "b"), ("a", 2, "c"), ("x", 0, "x")]
    steps = spark.createDataFrame([(1, 1, "failed"), (1, 2, "fallback"), (1, 3, "success"), (2, 4, "failed"), (2, 5, "skipped")], "c int, i int, status string")
    assert sorted((r.c, r.i) for r in guards.first_success(steps, ["c"], ["i"]).collect()) == [(1, 2), (2, 5)]


def test_names(spark):
    rows = [(23, "Chapter 23: Interlude 1"), (25, "Chapter 25: Enjoying life[ ... words ]"), (1, "Chapter 1, a percy jackson fanfic"), (23, "Chapter 23"), (1, "Prologue: The Beginning"), (7, None)]
    df = spark.createDataFrame(rows, "n int, t string")
    got = [r[0] for r in df.select(naming.chapter_file(F.col("n"), F.col("t"))).collect()]
    assert got == ["0023_Interlude_1.md", "0025_Enjoying_life[_._words.md", "0001_Chapter1.md", "0023_Chapter23.md", "0001_Prologue_The_Beginning.md", "0007_untitled.md"]
    assert naming.slug("CON") == "CON_file" and naming.slug('a<b>:"c"') == "abc" and naming.slug("") == "untitled" and len(naming.slug("x" * 300)) == 80


def test_profiles(spark):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    df = spark.createDataFrame([("2024-01-02 00:00:01",), ("2024-01-01 00:00:00",), (None,)], "t string").select(profiles.is_fresh(F.col("t").cast("timestamp"), now).alias("f"))
    assert [r.f for r in df.collect()] == [True, False, False]
    schema = "domain string, sel string, confidence double, remove_selectors array<string>, requires_playwright boolean"
    a = spark.createDataFrame([("d", "x", 0.5, ["p", "q"], False), ("e", None, None, [], None)], schema)
    b = spark.createDataFrame([("d", "y", 0.9, ["q"], True), ("e", "z", 0.1, ["r"], None)], schema)
    got = {r.domain: (r.sel, r.remove_selectors, r.requires_playwright, r.conflicts) for r in profiles.reconcile(a, b, "domain", ["sel"]).collect()}
    assert got == {"d": ("y", ["q"], True, ["sel"]), "e": ("z", ["r"], False, [])}
    left = profiles.forget(a, spark.createDataFrame([("www.d",)], "domain string")).collect()
    assert [r.domain for r in left] == ["e"]
    assert profiles.upsert(a, b.where("domain = 'd'"), "domain").where("sel = 'y'").count() == 1


PAGE = """<html><head><title>Chapter 2 | Royal Road</title><script>var x="</p>";</script></head><body><nav><a href="/">Next</a></nav>
<div class="ad hidden">ad</div><span class="%s">stolen text</span><p class="%s">kept prose</p>
<article id="c"><h1>Chapter 2: <i>Rain</i></h1><p>%s</p><p><b>Bold</b> and <a href="/x">link</a><br>next</p><ul><li>one</li></ul><hr><img data-src="/i.png" alt="pic">
<table><tr><th>a</th><td>b|c</td></tr></table></article><a rel="next" href="chapter-3">go</a></body></html>""" % ("A" * 40, "B" * 40, (LONG + " ") * 5)


def test_dom():
    root = filtered(tree(PAGE))
    assert "stolen" not in root.text() and "kept prose" in root.text() and not select(root, ".ad")
    assert [e.tag for e in select(root, "article > p:contains('BOLD')")] == ["p"] and first(root, "#c h1 i").text() == "Rain"
    assert first(root, "a[rel=next]").attrs["href"] == "chapter-3"
    md = Markdown({"tables": True}, "https://s.example/b/")
    text = md.render(first(root, "article"))
    assert text.startswith("# Chapter 2: *Rain*\nThis line") and "**Bold** and link\nnext" in text and "- one\n\n---\n\n![pic](IMG_PLACEHOLDER_0)" in text and "| a | b\\|c |" in text
    assert md.images[0]["original_url"] == "https://s.example/i.png"
    assert "- one" in plain_text(first(root, "article")) and "---" in plain_text(first(root, "article"))
    assert tree("<p><b>x<p>y</div>").text() == "xy"


def test_extraction(spark):
    df = spark.createDataFrame([(PAGE, "https://s.example/b/chapter-2"), (None, None), ("", "u"), ("<broken", "u")], "html string, url string")
    df = with_candidates(df, "html", "url")
    rows = df.select(*(c.alias(n) for n, c in chosen(F.col("page"), F.col("url")).items())).collect()
    assert rows[0].title == "Chapter 2: Rain" and rows[0].next_url == "https://s.example/b/chapter-3" and rows[0].next_method == "rel_next" and LONG in rows[0].content
    assert rows[1].content is None and rows[1].next_url is None
    page = read_page('<select id="chapter"><option value="/c1">1</option><option selected value="/c2">2</option><option value="/c3">3</option></select>', "https://a.b/c2", None, None, None, None, {})
    assert page["dropdown_next"] == "https://a.b/c3"


def test_rendering(spark):
    body = "# T\nline\n```\ncode\n```\n> q\n\n- x"
    df = spark.createDataFrame([("It's", 3, body, "https://u.example")], "t string, i int, b string, u string")
    out = df.select(*(render.rendered(m, F.col("t"), F.col("i"), F.col("b"), F.col("u"), F.lit(None).cast("string")).alias(m) for m in render.MODES)).first()
    assert out.obsidian == f'---\ntitle: "It\'s"\nchapter_index: 3\nsource_url: https://u.example\n---\n\n# T\n{render.INDENT}line\n```\ncode\n```\n> q\n\n- x\n\n> Source: https://u.example'
    assert out.raw.startswith("It's\n\nline")
    with pytest.raises(ValueError):
        render.rendered("pdf", *[F.lit("")] * 5)
    f = spark.createDataFrame([("s", "0001_a.md", "---\ntitle: 'x'\n---\nbody"), ("s", "0002_b.md", "body"), ("s", render.INDEX_FILE, "")], "s string, f string, c string")
    near = render.with_neighbours(f, "s", "f")
    once = near.withColumn("c", render.with_navigation(F.col("c"), F.col("prev_file"), F.col("next_file")))
    twice = once.withColumn("d", render.with_navigation(F.col("c"), F.col("prev_file"), F.col("next_file"))).collect()
    assert len(twice) == 2 and all(r.c == r.d for r in twice)
    assert "[0002_b →](0002_b.md)" in twice[0].c and once.select(render.front_matter(F.col("c")).alias("m")).first().m == {"title": "x"}
    img = spark.sql("select '![p](IMG_PLACEHOLDER_0) ![p](IMG_PLACEHOLDER_0)' as c, array(named_struct('original_url','u','local_path','l.png','alt_text','p','position_marker','IMG_PLACEHOLDER_0')) as i")
    assert img.select(render.apply_images(F.col("c"), F.col("i"), "obsidian").alias("v")).first().v == "![p](l.png) ![p](IMG_PLACEHOLDER_0)"


def book() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/c.opf"/></rootfiles></container>')
        z.writestr(
            "OPS/c.opf",
            '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Bk</dc:title></metadata><manifest><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'
            '<item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/></manifest><spine toc="n"><itemref idref="a"/><itemref idref="b"/></spine></package>',
        )
        z.writestr("OPS/toc.ncx", '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>One</text></navLabel><content src="a.xhtml#s"/></navPoint></navMap></ncx>')
        z.writestr("OPS/a.xhtml", "<html><body><p>A</p></body></html>")
        z.writestr("OPS/b.xhtml", "<html><body><p>B</p></body></html>")
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "x.epub").write_bytes(book())
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    (tmp_path / "links.txt").write_text("# c\n\n!relearn Site.example\nhttps://a.example/1\nnot a link\n", encoding="utf-8")
    (tmp_path / "t.txt").write_text("Chapter 1\nx", encoding="utf-8")
    (tmp_path / "bad.txt").write_bytes(b"\xc3\x28")
    all_files = files.binary(spark, str(tmp_path))
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in files.input_kind(all_files.where("path not like '%/bad.txt'")).collect()}
    assert kinds == {"x.epub": "epub", "bad.epub": "epub", "links.txt": "web", "t.txt": "txt"}
    good, bad = files.texts(all_files.where("path like '%.txt'"))
    assert good.count() == 2 and bad.count() == 1
    urls, again = files.links(spark, str(tmp_path / "links.txt"))
    assert [r.url for r in urls.collect()] == ["https://a.example/1"] and [r.domain for r in again.collect()] == ["site.example"]
    docs = files.epub_documents(all_files.where("path like '%.epub'"))
    assert docs.where("error is not null").count() == 1
    spine = docs.where("error is null").select(F.col("path").alias("book"), "pos", "doc_id", "file", "toc_title")
    made = files.epub_chapters(docs, chapters.chapter_plan(spine)).collect()
    assert [(r.chapter_index, r.title, r.html) for r in made] == [(1, "One", "<html><body><p>A</p>\n<hr/>\n<p>B</p></body></html>")]
    done = all_files.where("path like '%x.epub'").select("sha256")
    assert files.unprocessed(all_files, done).count() == 4
    (tmp_path / "c.toml").write_text('[run]\noutput_mode = "raw"\nmax_keywords = 5\n')
    c = config.load(str(tmp_path / "c.toml"), max_keywords=7)
    assert (c.output_mode, c.max_keywords) == ("raw", 7)
    with pytest.raises(ValueError):
        config.load(output_mode="pdf")
    render.export(spark.createDataFrame([("s/../x", "0001.txt", "hé")], "folder string, file string, content string"), str(tmp_path / "out"))
    assert [p.read_text(encoding="utf-8") for p in (tmp_path / "out").rglob("*.txt")] == ["hé"]


def test_streams(spark, tmp_path):
    from quire.streaming import stories as S

    inbox, ck = tmp_path / "in", str(tmp_path / "ck")
    inbox.mkdir()
    for n, b in (("a.epub", b"1"), ("b.epub", b"1"), ("c.epub", b"2")):
        (inbox / n).write_bytes(b)
    got = []
    for _ in range(2):
        S.run_inbox(S.watch(spark, str(inbox)), lambda df: got.append(df.count()), str(tmp_path / "manifest"), ck).awaitTermination()
    assert sum(got) == 2 and spark.read.parquet(str(tmp_path / "manifest")).count() == 2
    rows = [(1, 1, "u1", True, "f1"), (1, 2, "u2", False, None), (1, 3, "u3", True, "f1"), (1, 4, "u4", True, "f9"), (2, 1, "v", True, "g")]
    schema = "story_id bigint, at bigint, url string, ok boolean, fp string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "steps"))
    q = S.progress(spark.readStream.schema(schema).parquet(str(tmp_path / "steps"))).writeStream.format("memory").queryName("prog").outputMode("update").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.story_id: (r.chapters, r.stopped, r.reason) for r in spark.table("prog").collect()} == {1: (1, True, "repeat"), 2: (1, False, None)}


def test_fetching_and_agents(spark):
    from pyspark.sql.types import StringType, StructField, StructType

    from quire.operators import agents, fetching

    ok, cf = "<html>" + "x" * 200, "<title>Just a moment...</title>" + "x" * 200
    rows = [(ok, 200, None, None, False), (cf, 403, ok, 200, False), (None, None, ok, 200, False), (ok, 200, ok, 200, True), (None, None, None, None, None), (cf, 503, None, None, False)]
    df = spark.createDataFrame(rows, "a string, s int, b string, t int, f boolean")
    got = [r.v and (r.v.method, r.v.confidence) for r in df.select(fetching.fetched(*(F.col(c) for c in "asbtf")).alias("v")).collect()]
    assert got == [("plain", 1.0), ("browser_challenge", 0.9), ("browser_fallback", 0.85), ("browser", 1.0), None, ("plain_blocked", 0.0)]
    assert agents.first_json('```json\n{"a": 1}\n```') == '{"a": 1}' and agents.first_json('x [1] {"b": 2}') == '{"b": 2}' and agents.first_json("none") is None
    schema = StructType([StructField("a", StringType())])
    p = spark.createDataFrame([("q",), (None,)], "p string")
    assert [r.o for r in agents.ask(p, "p", "o", schema).collect()] == [None, None]
    assert [r.o and r.o.a for r in agents.ask(p, "p", "o", schema, call=lambda x: '{"a": "' + x + '!"}').collect()] == ["q!", None]
    arr = spark.sql("select array('a','b') as c, array('b') as s, array('x','y') as n, array('y') as d")
    assert arr.select(agents.updated_selectors(*(F.col(c) for c in "csnd")).alias("v")).first().v == ["b", "x"]
    assert arr.select(agents.known_link(F.col("c"), F.lit("z")).alias("v")).first().v == "a"
    seen = spark.sql("select X'89504E470D0A' as c, 'text/html' as t union all select X'00', 'image/webp; q=1' union all select null, null")
    assert [r.v for r in seen.select(render.image_extension(F.col("t"), F.col("c")).alias("v")).collect()] == [".png", ".webp", ".jpg"]
    refs = spark.createDataFrame([("b", "../img/A.png"), ("b", "none.gif")], "book string, href string")
    items = spark.createDataFrame([("b", "img/a.png", "1"), ("b", "x/a.png", "2")], "book string, file string, content string")
    assert {r.href: r.file for r in render.match_images(refs, items).collect()} == {"../img/A.png": "img/a.png", "none.gif": None}
    assert {(r.href, r.change) for r in render.snapshot_diff(refs, refs.where("href like '%png'").union(refs.limit(1))).collect()} == {("none.gif", "-"), ("../img/A.png", "+")}
    mark = spark.createDataFrame([("www.royalroad.com", "Keep this.\nThis tale was stolen from Royal Road; report it.")], "d string, t string")
    none = spark.createDataFrame([], "domain string, keyword string")
    assert boilerplate.filter_lines(mark, F.col("d"), "t", none).first().t == "Keep this."


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "id long, domain string, text string")
    assert boilerplate.candidates(boilerplate.suspects(docs, F.col("domain"), F.col("text"))).count() == 0
    assert chapters.split_chapters(docs, "id", "text").count() == 0
    assert guards.duplicates(docs, "text", ["id"]).count() == 0
    assert lines.clean_content(docs, "text", "c").count() == 0
