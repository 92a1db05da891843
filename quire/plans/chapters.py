"""The whole job: raw pages to clean, numbered, deduplicated chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.functions.text import fingerprint, is_challenge, is_junk_page, length_score, prose_score, strip
from quire.functions.urls import is_numbered, page_type, site_key
from quire.operators.boilerplate import candidates, filter_lines, keyword_sets, keywords, suspects
from quire.operators.chapters import smart_title
from quire.operators.extract import body_of, chosen, with_candidates
from quire.operators.guards import copies, until_repeat
from quire.operators.lines import LEAST, clean_content, trimmed
from quire.operators.profiles import with_profile
from quire.operators.shared import materialize, with_python_column
from quire.sources.tables import table


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Raw documents with their site's selectors."""
    raw = table(spark, d, "raw_documents", spread=True)
    columns = ["content_selector", "next_selector", "title_selector", "remove_selectors"]
    return with_profile(raw, site_key(F.col("source_url")), table(spark, d, "site_profiles"), columns)


def parsed(spark: SparkSession, d: str) -> DataFrame:
    """Raw documents without junk pages, with the candidates of each page."""
    rows = pages(spark, d).where(~is_junk_page(F.col("html"), F.lit(200)) & ~is_challenge(F.col("html")) | F.col("source_path").isNotNull())
    rows = rows.withColumn("address", F.coalesce("source_url", "source_path"))
    profile = {"content": "content_selector", "title": "title_selector", "next": "next_selector", "remove": "remove_selectors"}
    return with_candidates(rows, "html", "address", profile)


def extracted(spark: SparkSession, d: str) -> DataFrame:
    """One row per raw document: chosen content, title and next link with the method of each. Junk pages give nulls."""
    rows = parsed(spark, d)
    return rows.select("raw_id", "chapter_index", "source_url", "source_path", "metadata", "ingested_at", *(c.alias(n) for n, c in chosen(F.col("page"), F.col("source_url")).items()))


def filtered(rows: DataFrame, words: DataFrame) -> DataFrame:
    """`rows` (domain, body) without boilerplate: keyword lines go before and after the edges are trimmed."""
    sets = keyword_sets(words)
    rows = filter_lines(rows, F.col("domain"), "body", sets)
    return filter_lines(with_python_column(rows, ["body"], "body", StringType(), trimmed), F.col("domain"), "body", sets)


def until_loop(rows: DataFrame) -> DataFrame:
    """Web pages of a story on a site end where the text of an earlier chapter comes again; books and pages without a place stay.

    The same chapter fetched again is a copy and no loop, so each text counts once a chapter.
    """
    walked = F.col("source_url").isNotNull() & F.col("chapter_index").isNotNull()
    at = rows.where(walked).select("story", "domain", "chapter_index", "fp").distinct().withColumn("walk", F.struct("story", "domain"))
    kept = until_repeat(at, "walk", "chapter_index", "fp").select("story", "domain", "chapter_index", "fp")
    return rows.where(walked).join(kept, ["story", "domain", "chapter_index", "fp"], "left_semi").select(rows.columns).unionByName(rows.where(~walked))


def without_learned(rows: DataFrame) -> DataFrame:
    """Books without the edge lines they repeat ten times and more, learned from their own chapters."""
    books = rows.where("source_path is not null")
    learned = candidates(suspects(books, F.col("domain"), F.col("body")), least=10, most=50).select("domain", F.col("line").alias("keyword"))
    return filter_lines(rows, F.col("domain"), "body", learned)


def chapters(spark: SparkSession, d: str, learned: DataFrame | None = None) -> DataFrame:
    """Clean chapters: content cleaned, boilerplate and title line dropped, index pages and short ones left out, a story
    on a site ended at a loop, copies within a story left out, numbered.

    `learned` (domain, keyword) adds keywords of earlier runs to those of the site profiles.
    """
    rows = parsed(spark, d)
    story = F.coalesce(F.col("metadata")["story_name"], F.col("source_url"), F.col("source_path"))
    kind = F.when(F.lower("source_path").endswith(".txt"), "txt:").otherwise("epub:")
    url = F.col("source_url")
    is_index = F.coalesce((page_type(url, F.col("page")["title_tag"]) == "index") & ~is_numbered(url), F.lit(False))
    pick = chosen(F.col("page"), url)
    title = F.coalesce(pick["title"], smart_title(F.col("metadata")["toc_title"], F.col("chapter_index")))
    rows = rows.where(~is_index).select(
        "raw_id", story.alias("story"), "chapter_index", title.alias("title"), "source_url", "source_path", pick["content_method"].alias("content_method"),
        pick["next_url"].alias("next_url"), pick["next_method"].alias("next_method"), F.coalesce(site_key(url), F.concat(kind, story)).alias("domain"),
        pick["content"].alias("content"),
    )
    rows = clean_content(rows, "content", "body").drop("content").where(F.length(strip(F.col("body"))) >= LEAST)
    none = spark.createDataFrame([], "domain string, keyword string")
    rows = filtered(rows, keywords(none if learned is None else learned, table(spark, d, "site_profiles")))
    rows = rows.withColumn("body", body_of(F.col("body"), F.col("title"))).withColumn("fp", fingerprint(F.col("body")))
    # learning, guards and result read the same rows: pages are parsed once
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "chapters")
    # copies, loops and numbers are found on narrow rows; the bodies meet them in one join
    keys = rows.select("row", "raw_id", "story", "domain", "chapter_index", "source_url", "fp")
    kept = until_loop(copies(keys, ["chapter_index", "raw_id", "row"], ["story"])).where("copy_no = 1")
    by = Window.partitionBy("story").orderBy("chapter_index", "raw_id", "row")
    rows = without_learned(rows.join(kept.select("row", F.row_number().over(by).alias("number")), "row"))
    score = F.greatest(length_score(F.col("body"))["score"] * 0.5, prose_score(F.col("body")))
    return rows.select(
        "raw_id", "story", "number", "chapter_index", "title", "content_method", "next_url", "next_method", "fp",
        F.round(score, 3).alias("score"), "body",
    )
