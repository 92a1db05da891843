"""Files as tables: input routing, link lists, plain text and EPUB books."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import urls
from quire.functions.text import lines, strip


def binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content, sha256) of all files a path or pattern names."""
    return spark.read.format("binaryFile").load(path).withColumn("sha256", F.sha2("content", 256))


def input_kind(files: DataFrame) -> DataFrame:
    """(path, kind): 'epub' and 'txt' by extension, but a text file whose first telling line is an address is 'web'.

    Blank lines, comments and directives among the first five lines are passed over; all else is 'web'.
    """
    head = F.slice(lines(F.decode(F.substring("content", 1, 8192), "utf-8")), 1, 5)
    told = F.filter(F.transform(head, strip), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("!relearn"))
    kind = (
        F.when(F.lower("path").endswith(".epub"), "epub")
        .when(F.lower("path").endswith(".txt"), F.when(F.try_element_at(told, F.lit(1)).rlike("(?i)^https?://"), "web").otherwise("txt"))
        .otherwise("web")
    )
    return files.select("path", kind.alias("kind"))


def links(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(url) and (domain): the valid addresses of a link list, and its !relearn directives."""
    rows = spark.read.text(path).select(strip(F.col("value")).alias("line")).where("line <> '' and not startswith(line, '#')")
    told = rows.where(urls.is_valid(F.col("line"))).select(F.col("line").alias("url"))
    again = rows.where("startswith(line, '!relearn')").select(F.lower(F.regexp_extract("line", r"^!relearn\s+(\S+)", 1)).alias("domain")).where("domain <> ''")
    return told, again


def texts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, text) of the files that are valid UTF-8, and (path) of those that are not: nothing is replaced silently."""
    good = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.regexp_replace(F.col("content").cast("string"), "^﻿", "")
    return files.where(good).select("path", text.alias("text")), files.where(~good).select("path")


_SPINE = "path string, pos int, doc_id string, file string, html string, toc_ord int, toc_title string, book_title string, author string, language string, error string"


def epub_documents(files: DataFrame) -> DataFrame:
    """One row per spine document of each book: place, id, file, html, and the title its table of contents gives it.

    A file that is no readable book gives one row with `error`. Books are read one at a time within a task.
    """

    names = [part.split()[0] for part in _SPINE.split(", ")]
    kinds = [pa.int32() if part.endswith(" int") else pa.string() for part in _SPINE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = _read_epub(content)
                except Exception as e:  # the book is broken: told in the row, the others go on
                    rows = [{"error": f"{type(e).__name__}: {e}"}]
                columns = [[path if n == "path" else r.get(n) for r in rows] for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, _SPINE)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _read_epub(content: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in container.iter() if _local(e.tag) == "rootfile")
        package = ElementTree.fromstring(z.read(opf))
        base = posixpath.dirname(opf)
        items, meta, spine, toc_id = {}, {}, [], None
        for e in package.iter():
            tag = _local(e.tag)
            if tag == "item":
                items[e.attrib["id"]] = e.attrib
            elif tag == "itemref":
                spine.append(e.attrib["idref"])
            elif tag == "spine":
                toc_id = e.attrib.get("toc")
            elif tag in ("title", "creator", "language") and e.text and tag not in meta:
                meta[tag] = e.text.strip()
        place = lambda href: posixpath.normpath(posixpath.join(base, href))
        titles = _toc(z, items, toc_id, place)
        by_name = {}
        for k, (ord_, t) in titles.items():
            by_name.setdefault(posixpath.basename(k), (ord_, t))
        rows = []
        for pos, idref in enumerate(spine):
            item = items.get(idref)
            if item is None or "html" not in item.get("media-type", "html"):
                continue
            file = place(item["href"])
            key = file.lower()
            ord_, title = titles.get(key) or by_name.get(posixpath.basename(key)) or (None, None)
            html = z.read(file).decode("utf-8", "replace")
            rows.append({"pos": pos, "doc_id": idref, "file": file, "html": html, "toc_ord": ord_, "toc_title": title, "book_title": meta.get("title"), "author": meta.get("creator"), "language": meta.get("language"), "error": None})
        return rows


def _toc(z: zipfile.ZipFile, items: dict, toc_id: str | None, place) -> dict[str, tuple[int, str]]:
    """File in lower case without fragment -> (order, title), from the navigation document or the NCX; the last wins."""
    out: dict[str, tuple[int, str]] = {}
    nav = next((i for i in items.values() if "nav" in i.get("properties", "").split()), None)
    ncx = items.get(toc_id) if toc_id else next((i for i in items.values() if i.get("media-type") == "application/x-dtbncx+xml"), None)
    if ncx is not None:
        root = ElementTree.fromstring(z.read(place(ncx["href"])))
        folder = posixpath.dirname(ncx["href"])
        for k, p in enumerate(e for e in root.iter() if _local(e.tag) == "navPoint"):
            label = next((" ".join("".join(t.itertext()).split()) for t in p.iter() if _local(t.tag) == "text"), "")
            src = next((t.attrib.get("src", "") for t in p if _local(t.tag) == "content"), "")
            if src and label:
                out[place(posixpath.join(folder, src.split("#")[0])).lower()] = (k, label)
    elif nav is not None:
        text = z.read(place(nav["href"])).decode("utf-8", "replace")
        folder = posixpath.dirname(nav["href"])
        for k, m in enumerate(re.finditer(r'(?is)<a\b[^>]*href="([^"#]+)[^"]*"[^>]*>(.*?)</a>', text)):
            out[place(posixpath.join(folder, m[1])).lower()] = (k, " ".join(re.sub(r"<[^>]*>", "", m[2]).split()))
    return out


def body_html(html) -> object:
    """Inner html of <body>, the whole where there is none."""
    inner = F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1)
    return F.when(inner != "", inner).otherwise(html)


def epub_chapters(documents: DataFrame, plan: DataFrame) -> DataFrame:
    """(path, chapter_index, title, html): the documents of each plan entry joined with a rule, in spine order.

    `plan` is the result of `chapter_plan` with book = path.
    """
    units = plan.select(F.col("book").alias("path"), "chapter_index", "title", F.posexplode("doc_ids").alias("ord", "doc_id"))
    joined = units.join(documents.select("path", "doc_id", body_html(F.col("html")).alias("body")), ["path", "doc_id"])
    merged = joined.groupBy("path", "chapter_index").agg(F.min("title").alias("title"), F.array_sort(F.collect_list(F.struct("ord", "body"))).alias("parts"))
    html = F.concat(F.lit("<html><body>"), F.array_join(F.transform("parts", lambda x: x["body"]), "\n<hr/>\n"), F.lit("</body></html>"))
    return merged.select("path", "chapter_index", "title", html.alias("html"))


def unprocessed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose content the manifest does not name; equal contents count once."""
    return files.join(manifest.select("sha256"), "sha256", "left_anti").dropDuplicates(["sha256"])
