"""Core queries that SQL cannot state against plain Python over the smallest tables, and fixed results on a small page."""

import os
import re

import pytest
from pyspark.sql import functions as F

from quire.operators import lines, naming
from quire.plans.queries import queries
from quire.sources.tables import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain_text(body: str, images: str) -> str:
    """Markdown to text by the survey's nine patterns, in Python's own regular expressions."""
    body = re.sub(r"!\[([^\]]*)\]\([^)]*\)", images, body)
    body = re.sub(r"(?<!!)\[([^\]]+)\]\([^)]*\)", r"\1", body)
    body = re.sub(r"\*\*(.+?)\*\*", r"\1", body, flags=re.S)
    body = re.sub(r"__(.+?)__", r"\1", body, flags=re.S)
    body = re.sub(r"(?<!\*)\*([^*\s][^*\n]*?[^*\s]|[^*\s])\*(?!\*)", r"\1", body)
    body = re.sub(r"(?<!_)_([^_\s][^_\n]*?[^_\s]|[^_\s])_(?!_)", r"\1", body)
    body = re.sub(r"^#{1,6}\s+", "", body, flags=re.M)
    body = re.sub(r"^>\s*", "", body, flags=re.M)
    return re.sub(r"\n{3,}", "\n\n", body).strip()


@pytest.mark.parametrize("mode, images", [("render_translate", r"[IMAGE: \1]"), ("render_raw", "")])
def test_text_modes(spark, mode, images):
    docs = {r.doc_id: r for r in table(spark, DATA, "documents").collect()}
    got = queries()[mode](spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        d = docs[r.doc_id]
        body = re.sub(r"^#{1,6}\s+[^\n]*\n*", "", d.text or "", count=1)
        title = (d.title or "").strip() or (f"Chapter {d.chapter_index}" if d.chapter_index is not None else None)
        assert r.content == (None if title is None else f"{title}\n\n{plain_text(body, images)}".rstrip() + "\n")


def test_cleaned_content(spark):
    rows = {r.ctx_id: r.content for r in table(spark, DATA, "pipeline_contexts").collect()}
    got = {r.ctx_id: r.clean for r in queries()["cleaned"](spark, DATA).collect()}
    assert got.keys() == rows.keys()
    for i, text in rows.items():
        clean, kept = got[i], lines.scrubbed(text)
        if kept is None:
            assert clean is None
        else:  # trimming takes lines off the ends only, and never leaves too little
            assert clean in kept and (clean == kept or len(clean.strip()) >= lines.LEAST)
            assert len(kept.strip()) >= 0.4 * len(text.strip()) or kept == text


def test_chapter_file_names(spark):
    rows = {r.doc_id: r for r in table(spark, DATA, "documents").select("doc_id", "title", "chapter_index").collect()}
    for r in queries()["chapter_files"](spark, DATA).collect():
        d = rows[r.doc_id]
        if d.chapter_index is None:
            assert r.file is None
            continue
        stem = re.fullmatch(rf"{d.chapter_index:04d}_(.+)\.md", r.file).group(1)
        title = re.sub(r"\s*\|.*$", "", (d.title or "").strip()[:200]).strip()
        sub = re.search(r"(?i)Chapter\s*(\d+)\s*[-–—:.]?\s*(.*)", title)
        if sub is None:
            assert stem == naming.slug(title)
        elif not sub[2].strip():
            assert stem == f"Chapter{sub[1]}"
        else:
            assert naming.slug(sub[2]).startswith(stem[:3]) or stem == f"Chapter{sub[1]}"
        assert not re.search(r'[<>:"/\\|?*\x00-\x1f\s]', r.file) and len(r.file) <= 124


def test_chapters_of_stories(spark):
    rows = queries()["chapters"](spark, DATA).collect()
    assert len(rows) > 50
    by = {}
    for r in rows:
        by.setdefault(r.story, []).append(r)
        assert len(r.body.strip()) >= lines.LEAST or r.body == "" or r.fp is not None
        assert "<script" not in r.body and not re.match(r"\s*#*\s*$", r.body)
    for of in by.values():
        of.sort(key=lambda r: r.number)
        assert [r.number for r in of] == list(range(1, len(of) + 1))
        assert len({r.fp for r in of}) == len(of)  # no copy within a story
        places = [r.chapter_index for r in of if r.chapter_index is not None]
        assert places == sorted(places)


def test_pages_give_what_they_show(spark):
    pages = {r.raw_id: r for r in table(spark, DATA, "raw_documents").where("html is not null and source_url is not null").collect()}
    got = queries()["pages_extracted"](spark, DATA).where("source_url is not null").collect()
    assert len(got) > 50
    for r in got:
        html = pages[r.raw_id].html
        if r.content:  # every word of the content stands in the page
            words = [w for w in re.findall(r"[A-Za-z]{5,}", r.content) if not w.isupper()]  # placeholders of images aside
            assert sum(w in html for w in words) >= 0.98 * len(words)


def test_runs_give_stable_columns(spark):
    for name in ("chapters", "pages_extracted", "cleaned"):
        df = queries()[name](spark, DATA)
        assert len(set(df.columns)) == len(df.columns)
        assert df.where(F.col(df.columns[0]).isNull()).count() == 0
