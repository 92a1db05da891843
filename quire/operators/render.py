"""Chapters as files: Markdown with front matter, plain text for translation, raw text; navigation and indexes."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.functions.text import strip, strip_markdown

INDENT = " "
INDEX_FILE = "0000_Index.md"
MODES = ("obsidian", "translate", "raw")


@F.pandas_udf(StringType())
def quoted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text in quotes as Python writes it."""
    for s in batches:
        yield s.map(repr, na_action="ignore")


def indent(body: Column) -> Column:
    """An em space before every line of prose; headings, quotes, lists, tables, rules, comments and code stay.

    The text is cut before each fence, so every other part is code and no line has to count the fences before it.
    """

    def one(x: Column) -> Column:
        special = x.rlike(r"^\s*(?:#|>|[-*+]\s|\d+\.\s|---\s*$|\||<!--|!\[|```)")
        return F.when((strip(x) == "") | special, x).otherwise(F.concat(F.lit(INDENT), x))

    def part(p: Column, k: Column) -> Column:
        return F.when(k % 2 == 1, p).otherwise(F.array_join(F.transform(F.split(p, "\n", -1), one), "\n"))

    parts = F.split(F.concat(F.lit("\n"), body), r"\n(?=[^\S\n]*```)", -1)
    whole = F.array_join(F.transform(parts, part), "\n")
    return F.when(F.startswith(whole, F.lit("\n")), F.substring(whole, F.lit(2), F.length(whole))).otherwise(whole)


def obsidian(title: Column, index: Column, body: Column, source_url: Column, source_path: Column, meta: Column | None = None) -> Column:
    """Front matter (with story_name, language and author of a metadata map), indented body, source line."""
    told = [] if meta is None else [F.when(F.length(meta[k]) > 0, F.concat(F.lit(f"{k}: "), quoted(meta[k]))) for k in ("story_name", "language", "author")]
    head = F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit("title: "), quoted(title)),
        F.concat(F.lit("chapter_index: "), index.cast("string")),
        F.concat(F.lit("source_url: "), source_url),
        F.concat(F.lit("source_path: "), source_path),
        *told,
        F.lit("---"),
        F.lit(""),
    )
    foot = F.when(source_url.isNotNull(), F.concat(F.lit("\n\n> Source: "), source_url)).otherwise(F.lit(""))
    return F.concat(head, F.lit("\n"), indent(F.coalesce(body, F.lit(""))), foot)


def _text(title: Column, index: Column, body: Column, images: str) -> Column:
    headless = F.regexp_replace(F.coalesce(body, F.lit("")), r"^#{1,6}\s+[^\n]*\n*", "")
    named = F.coalesce(F.nullif(strip(title), F.lit("")), F.concat(F.lit("Chapter "), index.cast("string")))
    return F.concat(F.regexp_replace(F.concat(named, F.lit("\n\n"), strip_markdown(headless, images)), r"\s+$", ""), F.lit("\n"))


def translation(title: Column, index: Column, body: Column) -> Column:
    """Title, empty line, text without markup; images as [IMAGE: alt]."""
    return _text(title, index, body, "[IMAGE: $1]")


def raw(title: Column, index: Column, body: Column) -> Column:
    """As `translation`, without images."""
    return _text(title, index, body, "")


def rendered(mode: str, title: Column, index: Column, body: Column, source_url: Column, source_path: Column) -> Column:
    if mode == "obsidian":
        return obsidian(title, index, body, source_url, source_path)
    if mode == "translate":
        return translation(title, index, body)
    if mode == "raw":
        return raw(title, index, body)
    raise ValueError(f"unknown output mode {mode!r}: one of {', '.join(MODES)}")


def nav_line(prev: Column, nxt: Column) -> Column:
    stem = lambda c: F.regexp_replace(c, r"\.md$", "")
    return F.concat_ws(
        " | ",
        F.concat(F.lit("[← "), stem(prev), F.lit("]("), prev, F.lit(")")),
        F.lit(f"[🏠 Index]({INDEX_FILE})"),
        F.concat(F.lit("["), stem(nxt), F.lit(" →]("), nxt, F.lit(")")),
    )


def with_neighbours(chapters: DataFrame, story: str, file: str) -> DataFrame:
    """`chapters` with prev_file and next_file by file name within each story; the index file takes no part."""
    by = Window.partitionBy(story).orderBy(file)
    rows = chapters.where(F.col(file) != INDEX_FILE)
    return rows.withColumn("prev_file", F.lag(file).over(by)).withColumn("next_file", F.lead(file).over(by))


def with_navigation(content: Column, prev: Column, nxt: Column) -> Column:
    """Content with navigation at both ends. Old navigation goes first, so doing it twice changes nothing."""
    nav = nav_line(prev, nxt)
    bare = F.regexp_replace(content, r"(?s)\n*<!-- nav-top -->.*?<!-- /nav-top -->\n*", "\n")
    bare = F.regexp_replace(bare, r"(?s)\n*(?:---\s*\n)?<!-- nav-bottom -->.*?<!-- /nav-bottom -->\n*$", "")
    bare = F.regexp_replace(bare, r"(?s)\n*(?:---\s*\n)?<!-- nav-links -->.*?<!-- /nav-links -->\n*", "\n")
    bare = F.regexp_replace(bare, r"^\s+", "")
    head = F.regexp_extract(bare, r"(?s)^(---\n.*?\n---)(?:\n|$)", 1)
    body = F.regexp_replace(F.regexp_replace(F.substr(bare, F.length(head) + 1), r"^\s+", ""), r"\s+$", "")
    return F.concat(
        F.when(head != "", F.concat(head, F.lit("\n\n"))).otherwise(F.lit("")),
        F.lit("<!-- nav-top -->\n"), nav, F.lit("\n<!-- /nav-top -->\n\n"), body,
        F.lit("\n\n---\n<!-- nav-bottom -->\n"), nav, F.lit("\n<!-- /nav-bottom -->\n"),
    )


def indexes(chapters: DataFrame, story: str, name: str, file: str, title: str, updated: Column) -> DataFrame:
    """(story, file, content): a numbered table of contents for each story."""
    rows = chapters.groupBy(story).agg(
        F.array_sort(F.collect_list(F.struct(F.col(file).alias("file"), F.col(title).alias("title")))).alias("all"),
        F.min(name).alias("__name"),
        F.max(updated).alias("__at"),
    )
    entry = F.transform("all", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". ["), F.replace(F.coalesce(x["title"], x["file"]), F.lit("]"), F.lit("\\]")), F.lit("]("), x["file"], F.lit(")")))
    content = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), F.coalesce("__name", F.lit("Untitled")), F.lit("\n")),
        F.lit("> [!abstract] Story Info"),
        F.concat(F.lit("> - **Chapters**: "), F.size("all").cast("string")),
        F.concat(F.lit("> - **Last updated**: "), F.date_format("__at", "yyyy-MM-dd")),
        F.lit(""),
        F.lit("## Chapters"),
        F.lit(""),
        F.array_join(entry, "\n"),
        F.lit(""),
    )
    return rows.select(story, F.lit(INDEX_FILE).alias("file"), content.alias("content"))


def front_matter(content: Column) -> Column:
    """Map of the simple key: value lines at a file's head."""
    block = F.regexp_extract(content, r"(?s)^---\n(.*?)\n---\n", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_]\w*\s*:"))
    return F.map_from_entries(
        F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^(\w+)", 1), F.regexp_replace(F.regexp_extract(x, r"^\w+\s*:\s*(.*)$", 1), r"^['\"]|['\"]$", "")))
    )


def apply_images(content: Column, images: Column, mode: str) -> Column:
    """Image placeholders replaced by local paths (or addresses), by [IMAGE: alt], or by nothing; `images` is an array of
    structs (original_url, local_path, alt_text, position_marker)."""

    def one(c: Column, i: Column) -> Column:
        target = F.coalesce(i["local_path"], i["original_url"])
        whole = F.concat(F.lit("!["), i["alt_text"], F.lit("]("), i["position_marker"], F.lit(")"))
        if mode == "obsidian":
            new = F.concat(F.lit("!["), i["alt_text"], F.lit("]("), target, F.lit(")"))
        else:
            new = F.concat(F.lit("[IMAGE: "), i["alt_text"], F.lit("]")) if mode == "translate" else F.lit("")
        at = F.instr(c, whole)
        return F.when(at > 0, F.concat(F.substr(c, F.lit(1), at - 1), new, F.substr(c, at + F.length(whole)))).otherwise(c)

    return F.aggregate(F.coalesce(images, F.array().cast("array<struct<original_url:string,local_path:string,alt_text:string,position_marker:string>>")), content, one)


def image_extension(content_type: Column, content: Column) -> Column:
    """Extension of an image by its declared type, else by its first bytes, else .jpg."""
    told = F.trim(F.lower(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(told.isin("image/jpeg", "image/jpg"), ".jpg").when(told == "image/png", ".png").when(told == "image/webp", ".webp").when(told == "image/gif", ".gif")
        .when(head.startswith("FFD8FF"), ".jpg").when(head.startswith("89504E47"), ".png").when(head.startswith("52494646") & F.contains(head, F.lit("57454250")), ".webp")
        .when(head.startswith("47494638"), ".gif").otherwise(".jpg")
    )


def match_images(refs: DataFrame, items: DataFrame) -> DataFrame:
    """`refs` (book, href) with the best item of `items` (book, file, content): the whole name, else without leading
    dots and folders, else that below OEBPS/, else below OPS/, else the bare file name. Unmatched references keep nulls."""
    name = lambda c: F.lower(F.substring_index(c, "/", -1))
    bare = lambda c: F.lower(F.regexp_replace(F.substring_index(c, "#", 1), r"^(?:\.{0,2}/)+", ""))
    below = lambda folder: F.concat(F.lit(folder), bare(F.col("href")))
    wanted = refs.select("book", "href", F.posexplode(F.array(F.col("href"), bare(F.col("href")), below("oebps/"), below("ops/"), name(F.col("href")))).alias("rank", "key")).distinct()
    keys = items.select("book", F.posexplode(F.array(F.col("file"), *[bare(F.col("file"))] * 3, name(F.col("file")))).alias("rank", "key"), "file", "content")
    hits = wanted.join(keys, ["book", "rank", "key"]).groupBy("book", "href").agg(F.min_by(F.struct("file", "content"), F.struct("rank", "file")).alias("hit"))
    return refs.join(hits, ["book", "href"], "left").select(*refs.columns, F.col("hit.file").alias("file"), F.col("hit.content").alias("content"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that a run lost ('-') or gained ('+') against a stored one; repeated rows count each."""
    gone, came = old.exceptAll(new).withColumn("change", F.lit("-")), new.exceptAll(old).withColumn("change", F.lit("+"))
    return gone.unionByName(came)


def changed(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` that are absent from `old` or differ from it."""
    o = old.select(*keys, F.col("content").alias("__old"))
    return new.join(o, keys, "left").where(F.col("__old").isNull() | (F.col("__old") != F.col("content"))).drop("__old")


def export(files: DataFrame, directory: str) -> None:
    """Write each (folder, file, content) row as a file below a shared directory, each under a temporary name first."""

    def write(rows: Iterator) -> None:
        for r in rows:
            folder = os.path.join(directory, re.sub(r"[^\w.\-]", "_", str(r.folder)))
            os.makedirs(folder, exist_ok=True)
            path = os.path.join(folder, os.path.basename(r.file))
            with open(path + ".tmp", "w", encoding="utf-8") as f:
                f.write(r.content)
            os.replace(path + ".tmp", path)

    files.select("folder", "file", "content").foreachPartition(write)
