"""Chapter boundaries of plain text and chapter plans of books, as window queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import let, lines, strip

# Fixed values of the task: the shipped boundary cases, in their order.
CASES = [
    ("vn_chuong_colon", "vi", r"^Chương\s+(\d+)\s*[:\-—]?\s*(.*)$"),
    ("vn_chuong_number_only", "vi", r"^Chương\s+(\d+)\s*$"),
    ("en_chapter_colon", "en", r"^Chapter\s+(\d+)\s*[:\-—]?\s*(.*)$"),
    ("en_chapter_number_only", "en", r"^Chapter\s+(\d+)\s*$"),
]
FRONT = [
    "contents", "table of contents", "cover", "title page", "about the book", "about the author", "dedication", "preface", "foreword",
    "introduction", "front matter", "publisher", "imprint", "credits",
]
BACK = [
    "acknowledg", "copyright", "appendix", "afterword", "back matter", "reading group", "discussion question", "newsletter", "about the author",
]
SKIP = [
    "extract from", "excerpt from", "also by", "praise for", "advert", "advertisement", "back ad", "out now", "find out what happens",
    "read on for", "preview of", "sneak peek",
]
MATTER_FILES = [
    "toc", "contents", "cover", "title", "copyright", "dedication", "acknowledg", "about_author", "about_book", "nav", "front", "publisher",
    "imprint", "footnote",
]
SKIP_FILES = ["advert", "ads_", "ads_back", "ads_front", "promo", "excerpt"]


def best_case(text: Column, cases: list[tuple[str, str, str]] | None = None, head: int = 100) -> Column:
    """struct(id, pattern, score) of the case that matches most of the first hundred lines; null where none matches.

    Ties go to the earlier case. One pass over the lines in the JVM: no join of documents and cases.
    """
    return let(F.transform(F.slice(lines(text), 1, head), strip), lambda rows: _best_of(rows, cases))


def _best_of(rows: Column, cases: list[tuple[str, str, str]] | None) -> Column:
    cases = CASES if cases is None else cases

    def hits(rows: Column, pattern: str) -> Column:
        return F.size(F.filter(rows, lambda x: x.rlike(pattern)))

    def best(rows: Column) -> Column:
        scored = [F.struct(hits(rows, p).alias("score"), F.lit(-k).alias("order"), F.lit(i).alias("id"), F.lit(p).alias("pattern")) for k, (i, _, p) in enumerate(cases)]
        return F.greatest(*scored) if len(scored) > 1 else scored[0]

    chosen = lambda b: F.when(b["score"] > 0, F.struct(b["id"].alias("id"), b["pattern"].alias("pattern"), b["score"].alias("score")))
    return let(best(rows), chosen)


def split_chapters(docs: DataFrame, id_col: str, text_col: str, cases: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(id, chapter_index, title, body): text cut at the lines its best case matches; what stands before the first is dropped.

    Texts no case fits give no row (see `without_case`). The cut works within the row: the places of the boundaries are
    an array, and each chapter is the slice up to the next one, so no line is exchanged.
    """

    def cuts(rows: Column) -> Column:
        """Lines and the places of the boundaries among them; the best case is chosen once a text."""
        hit = lambda case: F.transform(rows, lambda row, i: F.when(F.regexp_like(strip(row), case["pattern"]), i))
        at = let(_best_of(F.transform(F.slice(rows, 1, 100), strip), cases), lambda case: F.filter(hit(case), lambda i: i.isNotNull()))
        return F.struct(rows.alias("rows"), at.alias("at"))

    cut = docs.select(F.col(id_col).alias("id"), let(lines(F.col(text_col)), cuts).alias("c"))
    # taken apart row by row: an empty or null list of places gives no chapter
    parts = cut.select("id", F.inline(F.array("c"))).select("id", "rows", "at", F.posexplode("at").alias("k", "start"))
    end = F.coalesce(F.get(F.col("at"), F.col("k") + 1), F.size("rows"))
    body = strip(F.array_join(F.slice("rows", F.col("start") + 2, end - F.col("start") - 1), "\n"))
    return parts.select("id", (F.col("k") + 1).alias("chapter_index"), strip(F.get(F.col("rows"), F.col("start"))).alias("title"), body.alias("body"))


def without_case(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids of the texts in which no boundary case was found."""
    return docs.where(F.col(text_col).isNotNull() & best_case(F.col(text_col)).isNull()).select(F.col(id_col).alias("id"))


def to_paragraphs(text: Column) -> Column:
    """Text as <p> paragraphs: cut at empty lines, line feeds as <br/>, signs of markup escaped."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n", -1), strip), lambda x: x != "")
    escaped = F.transform(parts, lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")))
    return F.array_join(F.transform(escaped, lambda x: F.concat(F.lit("<p>"), F.replace(x, F.lit("\n"), F.lit("<br/>")), F.lit("</p>"))), "\n")


def to_page(title: Column, body: Column) -> Column:
    return F.concat(F.lit("<html><body><article><h1>"), title, F.lit("</h1>\n"), to_paragraphs(body), F.lit("</article></body></html>"))


def normal_href(href: Column) -> Column:
    return F.lower(F.replace(F.substring_index(href, "#", 1), F.lit("\\"), F.lit("/")))


def _holds(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return F.coalesce(out, F.lit(False))


def unit_kind(title: Column, file: Column) -> Column:
    """'skip', 'matter', 'start' or 'open' (no title: goes on with what is open) of a spine entry."""
    return (
        F.when(_holds(file, SKIP_FILES) | _holds(title, SKIP), "skip")
        .when(_holds(file, MATTER_FILES) | _holds(title, FRONT + BACK), "matter")
        .when(title.isNotNull(), "start")
        .otherwise("open")
    )


def smart_title(title: Column, index: Column) -> Column:
    """A bare number becomes Prologue (0) or Chapter n; null becomes Chapter index."""
    number = F.when(title.rlike(r"^\s*\d+\s*$"), F.trim(title).cast("int"))
    return (
        F.when(number == 0, "Prologue")
        .when(number.isNotNull(), F.concat(F.lit("Chapter "), number.cast("string")))
        .otherwise(F.coalesce(strip(title), F.concat(F.lit("Chapter "), index.cast("string"))))
    )


def chapter_plan(spine: DataFrame) -> DataFrame:
    """(book, chapter_index, kind, title, doc_ids) from (book, pos, doc_id, file, toc_title).

    Matter goes to index 0; an entry without a title joins the chapter that is open, and matter or skipped entries close
    it. One exchange by book: the open chapter is the last event before an entry.
    """
    by = Window.partitionBy("book").orderBy("pos", "doc_id")
    before = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = spine.withColumn("kind", unit_kind(F.col("toc_title"), F.col("file")))
    marked = marked.withColumn("event", F.last(F.when(F.col("kind") != "open", F.col("kind")), ignorenulls=True).over(before))
    marked = marked.withColumn("number", F.sum((F.col("kind") == "start").cast("int")).over(before))
    marked = marked.where("kind <> 'skip'")
    chapter = (F.col("kind") == "start") | ((F.col("kind") == "open") & (F.col("event") == "start"))
    marked = marked.withColumn("chapter_index", F.when(chapter, F.col("number")).otherwise(0))
    plan = marked.groupBy("book", "chapter_index").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"),
        F.min_by("toc_title", F.struct("pos", "doc_id")).alias("first_title"),
    )
    return plan.select(
        "book",
        "chapter_index",
        F.when(F.col("chapter_index") == 0, "matter").otherwise("chapter").alias("kind"),
        F.when(F.col("chapter_index") == 0, "Front Matter").otherwise(smart_title(F.col("first_title"), F.col("chapter_index"))).alias("title"),
        "doc_ids",
    )


def match_toc(spine: DataFrame, toc: DataFrame) -> DataFrame:
    """`spine` (book, pos, doc_id, file) with toc_title from `toc` (book, ord, href, title): by the whole href, else by
    its file name. Of equal hrefs the last title counts, of equal names the first."""
    name = lambda c: F.substring_index(c, "/", -1)
    t = toc.withColumn("href", normal_href(F.col("href")))
    whole = t.groupBy("book", "href").agg(F.max_by("title", "ord").alias("t1"))
    base = t.withColumn("base", name(F.col("href"))).groupBy("book", "base").agg(F.min_by("title", "ord").alias("t2"))
    s = spine.withColumn("href", normal_href(F.col("file"))).withColumn("base", name(F.col("href")))
    out = s.join(whole, ["book", "href"], "left").join(base, ["book", "base"], "left")
    return out.select(*spine.columns, F.coalesce("t1", "t2").alias("toc_title"))
