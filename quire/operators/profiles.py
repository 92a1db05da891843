"""Site profiles: lookup, freshness, reconciliation of two opinions, upsert."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_profile(docs: DataFrame, domain: Column, profiles: DataFrame, columns: list[str]) -> DataFrame:
    """`docs` with profile columns by domain; null where a site has none. AQE broadcasts the profiles while they are small."""
    p = profiles.select(F.col("domain").alias("__d"), *columns)
    return docs.withColumn("__k", domain).join(p, F.col("__k") == F.col("__d"), "left").drop("__k", "__d")


def is_fresh(learned: Column, now: Column, days: int = 30) -> Column:
    """Learned less than so many whole days ago; never learned is not fresh."""
    age = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(learned.cast("timestamp"))) / F.lit(86_400_000_000))
    return F.coalesce(age < days, F.lit(False))


def resolve(v1: Column, v2: Column, c1: Column, c2: Column) -> Column:
    """struct(value, conflict): equal or lone values stand; of two the surer one, the first where equally sure."""
    a, b = F.coalesce(v1, F.lit("")), F.coalesce(v2, F.lit(""))
    both = (a != "") & (b != "") & (a != b)
    value = F.when(a == b, v1).when(a == "", v2).when(b == "", v1).when(F.coalesce(c1, F.lit(0.5)) >= F.coalesce(c2, F.lit(0.5)), v1).otherwise(v2)
    return F.struct(value.alias("value"), both.alias("conflict"))


def reconcile(one: DataFrame, two: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Two opinions on each key as one: fields resolved, remove_selectors intersected where both name some, flags or-ed."""
    j = one.alias("a").join(two.alias("b"), key, "full")
    solved = {f: resolve(F.col(f"a.{f}"), F.col(f"b.{f}"), F.col("a.confidence"), F.col("b.confidence")) for f in fields}
    ra, rb = (F.coalesce(F.col(f"{s}.remove_selectors"), F.array().cast("array<string>")) for s in "ab")
    removed = F.when((F.size(ra) > 0) & (F.size(rb) > 0), F.array_intersect(ra, rb)).when(F.size(ra) > 0, ra).otherwise(rb)
    conflicts = F.filter(F.array(*(F.when(s["conflict"], F.lit(f)) for f, s in solved.items())), lambda x: x.isNotNull())
    flag = F.coalesce(F.col("a.requires_playwright"), F.lit(False)) | F.coalesce(F.col("b.requires_playwright"), F.lit(False))
    return j.select(
        key,
        *(s["value"].alias(f) for f, s in solved.items()),
        F.array_sort(F.array_distinct(removed)).alias("remove_selectors"),
        flag.alias("requires_playwright"),
        conflicts.alias("conflicts"),
    )


def confidence(scores: list[Column], chapters: Column) -> Column:
    """Mean of the scores there are, else 0.5 and 0.03 a chapter up to ten; two places."""
    known = F.filter(F.array(*(F.when(s != 0, s.cast("double")) for s in scores)), lambda x: x.isNotNull())
    total = reduce(lambda a, b: a + b, (F.coalesce(F.when(s != 0, s.cast("double")), F.lit(0.0)) for s in scores))
    return F.round(F.when(F.size(known) > 0, total / F.size(known)).otherwise(F.lit(0.5) + F.lit(0.03) * F.least(chapters, F.lit(10))), 2)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new`, and of `old` those whose key is not in it."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def forget(profiles: DataFrame, domains: DataFrame) -> DataFrame:
    """Profiles without the named domains and their www. variants."""
    named = domains.select(F.regexp_replace("domain", r"^www\.", "").alias("__d")).distinct()
    return profiles.join(named, F.regexp_replace(profiles["domain"], r"^www\.", "") == F.col("__d"), "left_anti")


def script_heavy(browser_chars: Column, plain_chars: Column) -> Column:
    """Whether a page shows much more text in a browser than without scripts."""
    return F.coalesce((browser_chars > plain_chars * 1.5) & (browser_chars - plain_chars > 500), F.lit(False))
