"""Learning as table jobs: what a site's learning round keeps, checks and names; model answers come in as tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.functions.text import let, lines, strip
from quire.operators.boilerplate import candidates, filter_lines, suspects

# Fixed values of the task: tags that are dropped anyway and need no selector, and the defaults of formatting rules.
ALWAYS_DROPPED = ["script", "style", "noscript", "iframe"]
RULES = (
    "tables boolean, math_support boolean, math_format string, special_symbols array<string>, bold_italic boolean, hr_dividers boolean, image_alt_strategy string, "
    "image_alt_text boolean, system_box struct<found:boolean,selectors:array<string>>, hidden_text struct<found:boolean,selectors:array<string>>, "
    "author_note struct<found:boolean,selectors:array<string>>"
)


def sanitised_selectors(selectors: Column) -> Column:
    """Selectors without empty ones and those of elements that are dropped anyway; null gives none."""
    kept = F.filter(selectors, lambda s: (strip(s) != "") & ~F.lower(strip(s)).isin(ALWAYS_DROPPED))
    return F.coalesce(kept, F.array().cast("array<string>"))


@F.pandas_udf(StringType())
def valid_pattern(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A regular expression if it compiles, else null."""

    def one(p: str | None) -> str | None:
        try:
            return p if p and re.compile(p) else None
        except re.error:
            return None

    for s in batches:
        yield s.map(one, na_action="ignore")


def formatting_rules(answer: Column) -> Column:
    """Formatting rules of a JSON answer as a struct in which nothing is missing; broken or null JSON gives the defaults."""
    r = F.from_json(answer, RULES)
    box = lambda name: F.struct(
        F.coalesce(r[name]["found"], F.lit(False)).alias("found"), F.coalesce(r[name]["selectors"], F.array().cast("array<string>")).alias("selectors")
    ).alias(name)
    alt = F.coalesce(r["image_alt_strategy"], F.when(r["image_alt_text"], "preserve").otherwise("skip"))
    return F.struct(
        F.coalesce(r["tables"], F.lit(False)).alias("tables"), F.coalesce(r["math_support"], F.lit(False)).alias("math_support"), r["math_format"].alias("math_format"),
        F.coalesce(r["special_symbols"], F.array().cast("array<string>")).alias("special_symbols"), F.coalesce(r["bold_italic"], F.lit(True)).alias("bold_italic"),
        F.coalesce(r["hr_dividers"], F.lit(True)).alias("hr_dividers"), alt.alias("image_alt_strategy"), box("system_box"), box("hidden_text"), box("author_note"),
    )


def snippet(html: Column, most: int = 10_000) -> Column:
    """Html cut for a model: whole if short, else without scripts and styles, else the first characters of its text."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</(?:script|style|noscript)\s*>", "")
    text = strip(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", "\n"), r"\s*\n\s*", "\n"))
    return F.when(F.length(html) <= most, html).otherwise(let(bare, lambda b: F.when(F.length(b) <= most, b).otherwise(F.substring(text, 1, most))))


def pattern_holds(text: Column, pattern: Column, key: Column, chunks: int = 3, size: int = 80, least: int = 240) -> Column:
    """Whether a boundary pattern is met in each of a few chunks of lines, drawn by a hash of the key; short texts pass."""

    def drawn(ls: Column) -> Column:
        n = F.size(ls)
        starts = [F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{k}"))), 1, 8), 16, 10).cast("long") % F.greatest(n - size + 1, F.lit(1)) for k in range(chunks)]
        hits = [F.exists(F.slice(ls, s.cast("int") + 1, size), lambda x: F.regexp_like(strip(x), pattern)) for s in starts]
        met = hits[0]
        for h in hits[1:]:
            met = met & h
        return F.when(n < least, True).otherwise(met)

    return let(lines(text), drawn)


def common_prefix(texts: Column) -> Column:
    """Longest prefix all texts of an array share: that of the least and the greatest of them."""

    def shared(e: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(e["lo"]), F.lit(1)))
        same = F.filter(places, lambda i: F.substr(e["lo"], F.lit(1), i) == F.substr(e["hi"], F.lit(1), i))
        return F.substr(e["lo"], F.lit(1), F.coalesce(F.array_max(same), F.lit(0)))

    return let(F.struct(F.array_min(texts).alias("lo"), F.array_max(texts).alias("hi")), shared)


def story_names(chapters: DataFrame, story: str, order: list[str], title: str, most: int = 5) -> DataFrame:
    """(story, name): what the first titles of a story have in common, without signs at its end; null where that is under
    three characters. Each partition keeps the first few titles only, so a story of any length is light."""
    rank = F.row_number().over(Window.partitionBy(story).orderBy(*order))
    first = chapters.where(F.col(title).isNotNull()).withColumn("__r", rank).where(F.col("__r") <= most)
    name = F.regexp_replace(common_prefix(F.col("__t")), r"[\s\-–—:|,.#(\[0-9]+$", "")
    out = first.groupBy(story).agg(F.collect_list(title).alias("__t")).withColumn("name", name)
    return out.select(story, F.when(F.length("name") >= 3, F.col("name")).alias("name"))


def until_index(pages: DataFrame, story: str, order: str, is_index: Column) -> DataFrame:
    """`pages` of each story before its first index page, and `completed`: whether there was one."""
    stop = F.min(F.when(F.coalesce(is_index, F.lit(False)), F.col(order))).over(Window.partitionBy(story))
    rows = pages.withColumn("__stop", stop).withColumn("completed", F.col("__stop").isNotNull())
    return rows.where(F.col("__stop").isNull() | (F.col(order) < F.col("__stop"))).drop("__stop")


def append_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`old`, and the rows of `new` whose key it has not: a known case is never changed."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def new_suspects(docs: DataFrame, domain: Column, text: Column, known: DataFrame, least: int = 5, most: int = 20) -> DataFrame:
    """(domain, line, n, rank): frequent edge lines that no known keyword names yet, for a model or a person to confirm."""
    return candidates(suspects(docs, domain, text, known), least=least, most=most).drop("kind")


def confirmed(suspected: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(domain, keyword) of the suspects a verdict table (domain, line) confirms; without one, none is."""
    rows = suspected.select("domain", F.col("line").alias("keyword"))
    return rows.limit(0) if verdicts is None else rows.join(verdicts.select("domain", F.col("line").alias("keyword")).distinct(), ["domain", "keyword"], "left_semi")


def retro_cleaned(docs: DataFrame, domain: Column, text_col: str, known: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Documents cleaned a second time with what the run itself has learned: automatic keywords and confirmed suspects."""
    counts = suspects(docs, domain, F.col(text_col), known)
    auto = candidates(counts).where("kind = 'auto'").select("domain", F.col("line").alias("keyword"))
    more = confirmed(candidates(counts, least=5), verdicts)
    return filter_lines(docs, domain, text_col, auto.unionByName(more).distinct())


def profile_summary(domain: Column, found: Column, confidence: Column, selector: Column, nav: Column) -> Column:
    """One line on a site's profile."""
    shown = lambda c: F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("None"))
    told = F.concat(domain, F.lit(": conf="), F.format_string("%.2f", F.coalesce(confidence, F.lit(0.0))), F.lit(" | content="), shown(selector), F.lit(" | nav="), shown(nav))
    return F.when(found, told).otherwise(F.concat(domain, F.lit(": no profile")))


def matching_profiles(profiles: DataFrame, pattern: str) -> DataFrame:
    """Profiles whose domain matches a pattern, in order: what a bulk relearn would drop."""
    return profiles.where(F.col("domain").rlike(f"(?i){pattern}")).orderBy("domain")
