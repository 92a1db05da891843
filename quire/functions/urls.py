"""URL logic as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Host of an absolute url in lower case; '' where there is none, null for null."""
    return F.lower(F.regexp_extract(url, r"(?i)^\s*[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#\s]+)", 1))


def site_key(url: Column) -> Column:
    """Host without one leading ``www.`` or ``m.``."""
    return F.regexp_replace(host(url), r"^(?:www|m)\.", "")


# Fixed values of the task: how chapter addresses look.
CHAPTER = r"(?i)(?:chapter|chuong|chap)[_\-/]?\d+|/ch?[/_-]\d+|(?:episode|ep|part)[_\-/]?\d+|/s/\d+/\d+|/txt/\d+/\d+"
SLUG = r"(?i)(.*?(?:chapter|chuong|chap|/c|/ep|episode|part|phan|tap)[s_-]?)(\d+)(/?(?:[?#].*)?)$"
INDEX = r"(?i)/(chapters|chapter-list|table-of-contents?|toc|contents|index|fiction|novel|works?)(?:[/?#]|$)"


def is_valid(url: Column) -> Column:
    """http or https with a host."""
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#]+"), F.lit(False))


def path(url: Column) -> Column:
    """Path without query and fragment."""
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/", -1), lambda s: s != "")


def is_chapter(url: Column, pattern: Column | None = None) -> Column:
    """Whether an address is a chapter's, by the site's own pattern or the common one."""
    common = url.rlike(CHAPTER)
    return common if pattern is None else F.coalesce(F.expr("false") | url.rlike(pattern), F.lit(False)) | common


def page_type(url: Column, title: Column | None = None, heading: Column | None = None) -> Column:
    """'chapter', 'index' or 'other' from the address, then the title, then the first heading."""
    out = F.when(url.rlike(CHAPTER), "chapter").when(path(url).rlike(INDEX), "index")
    if title is not None:
        out = out.when(title.rlike(r"(?i)\b(table of contents?|toc|all chapters?|chapter list)\b"), "index")
    if heading is not None:
        out = out.when(heading.rlike(r"(?i)\b(chapter|chap|chương|episode|ep|part)\b[\s.\-:]*\d+"), "chapter")
    return out.otherwise("other")


def is_numbered(url: Column) -> Column:
    """Whether the path ends in a number, as a chapter's does below an index's (`/s/9/chapters/3`, `/novel/x/3.html`)."""
    return path(url).rlike(r"/\d+(?:\.\w+)?/?$")


def next_by_slug(url: Column) -> Column:
    """The address with its chapter number one higher; null where it has none."""
    head, number, tail = (F.regexp_extract(url, SLUG, k) for k in (1, 2, 3))
    return F.when(number != "", F.concat(head, (number.cast("decimal(30,0)") + 1).cast("string"), tail))


def next_by_story(url: Column) -> Column:
    """/s/<id>/<n> with n one higher; null elsewhere."""
    pattern = r"(/s/\d+/)(\d+)(/.+)?$"
    number = F.regexp_extract(url, pattern, 2)
    start = F.regexp_replace(url, pattern, "")
    moved = F.concat(start, F.regexp_extract(url, pattern, 1), (number.cast("decimal(30,0)") + 1).cast("string"), F.regexp_extract(url, pattern, 3))
    return F.when(number != "", moved)


def story_prefix(url: Column) -> Column:
    """Part of the path that stays the same within a story; null where nothing tells."""
    s = segments(url)
    fan = (F.size(s) >= 3) & (F.get(s, F.lit(0)) == "s") & F.get(s, F.lit(1)).rlike(r"^\d+$")
    marks = F.transform(s, lambda x, i: F.when((i > 0) & x.rlike(r"^\d+(?:-|$)"), i))
    first = F.array_min(F.filter(marks, lambda i: i.isNotNull()))
    hit = F.get(s, first)
    before = F.concat(F.lit("/"), F.array_join(F.slice(s, 1, first), "/"))
    generic = F.when(hit.rlike(r"^\d+-"), F.concat(before, F.lit("/"), F.regexp_extract(hit, r"^(\d+)-", 1))).otherwise(
        F.concat(before, F.lit("/"), hit, F.lit("/"))
    )
    return F.when(fan, F.concat(F.lit("/s/"), F.get(s, F.lit(1)), F.lit("/"))).when(first.isNotNull(), generic)


def domain_tag(url: Column) -> Column:
    """First label of the host in at most twelve characters, padded to twelve."""
    name = F.split(F.replace(F.when(url.startswith("http"), host(url)).otherwise(F.lower(url)), F.lit("www."), F.lit("")), r"\.", -1)
    return F.rpad(F.substring(F.get(name, F.lit(0)), 1, 12), 12, " ")


def title_from_slug(url: Column) -> Column:
    """Title from the last telling segment of an http address; null where there is none. A letter after any other
    character becomes a capital."""
    chosen = F.filter(segments(url), lambda s: ~s.rlike(r"^\d+$") & (F.length(s) > 3))
    slug = F.try_element_at(chosen, F.lit(-1))
    bare = F.regexp_replace(F.regexp_replace(slug, r"(?i)(?:chapter|chap|ch|episode|ep|part)[_-]?\d+", ""), r"^[-_ ]+|[-_ ]+$", "")
    words = F.trim(F.regexp_replace(bare, r"[-_]+", " "))
    title = F.array_join(F.transform(F.split(F.lower(words), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), " ")
    return F.when(is_valid(url) & (F.length(words) >= 3), title)


def output_dir(url: Column) -> Column:
    """Site and the first two segments of the path, joined for a folder's name."""
    return F.array_join(F.concat(F.array(site_key(url)), F.slice(segments(url), 1, 2)), "/")
