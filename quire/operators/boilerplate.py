"""Boilerplate learning across documents: count edge lines, choose keywords, filter lines with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import any_match, is_keyword, let, lines, strip
from quire.operators.shared import sized_broadcast

# Fixed values of the task: watermarks known for one site.
BUILT_IN = {
    "royalroad.com": [
        "support the author by reading on royal road", "read the original on royal road", "royal road is the home of this novel",
        "royal road as an amazon associate",
    ]
}


# Fixed values of the task: rotating watermarks of one site, by words that stand near its name.
PATTERNS = {
    "royalroad.com": [
        r"\bamazon\b.{0,80}\b(permission|consent|author|report|stolen|taken|pilfered|appropriated|misappropriated|illicit|illegal|unlawful|unauthori[sz]ed|violation)\b",
        r"\b(permission|consent|stolen|taken|pilfered|appropriated|misappropriated|illicit|illegal|unlawful|unauthori[sz]ed|lifted|reported|report it)\b.{0,80}\bamazon\b",
        r"\b(stolen|taken|pilfered|appropriated|misappropriated|illicit|illegal|unlawful|unauthori[sz]ed|lifted)\b.{0,80}\broyal\s*road\b",
    ]
}


def has_watermark(line: Column, domain: Column) -> Column:
    """Whether a line shows one of its site's rotating watermarks."""
    return _watermark(line, _bare_domain(domain))


def _bare_domain(domain: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(domain, F.lit(""))), r"^(?:epub:|txt:|www\.)+", "")


def _watermark(line: Column, site: Column) -> Column:
    out = F.lit(False)
    for name, patterns in PATTERNS.items():
        out = out | ((site == name) & any_match(line, [f"(?i){p}" for p in patterns]))
    return F.coalesce(out, F.lit(False))


def edge_lines(docs: DataFrame, domain: Column, text: Column, edge: int = 5) -> DataFrame:
    """(domain, line): first and last five filled lines of each document in lower case; a short document gives a line twice."""
    filled = F.filter(F.transform(lines(text), strip), lambda x: x != "")
    size = F.size(filled)
    ends = F.concat(F.slice(filled, 1, edge), F.slice(filled, F.greatest(size - edge + 1, F.lit(1)), edge))
    rows = docs.select(domain.alias("domain"), F.explode(ends).alias("line")).withColumn("line", F.lower("line"))
    return rows.where(F.length("line").between(10, 300) & is_keyword(F.col("line")))


def suspects(docs: DataFrame, domain: Column, text: Column, known: DataFrame | None = None) -> DataFrame:
    """(domain, line, n): edge lines by occurrence, without keywords already known for the domain or everywhere."""
    rows = edge_lines(docs, domain, text)
    counts = rows.groupBy("domain", "line").agg(F.count("*").alias("n"))
    if known is not None:
        own = known.where("domain <> 'global'").select("domain", F.col("keyword").alias("line"))
        every = known.where("domain = 'global'").select(F.col("keyword").alias("line"))
        counts = counts.join(own, ["domain", "line"], "left_anti").join(every, "line", "left_anti")
    return counts


def candidates(counts: DataFrame, auto: int = 10, least: int = 3, most: int = 20) -> DataFrame:
    """(domain, line, n, rank, kind): the most frequent suspects of each domain, 'auto' from ten on, 'review' from three.

    Ties go by the line itself, so the result does not depend on the order rows arrive in.
    """
    by = Window.partitionBy("domain").orderBy(F.desc("n"), "line")
    ranked = counts.where(F.col("n") >= least).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)
    return ranked.withColumn("kind", F.when(F.col("n") >= auto, "auto").otherwise("review"))


def keywords(learned: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """(domain, keyword): learned, profile and built-in keywords, each once and valid."""
    spark = learned.sparkSession
    built = spark.createDataFrame([(d, k) for d, ks in BUILT_IN.items() for k in ks], "domain string, keyword string")
    out = learned.select("domain", F.lower(strip(F.col("keyword"))).alias("keyword")).unionByName(built)
    if profiles is not None:
        own = profiles.select("domain", F.explode("ads_keywords_learned").alias("keyword"))
        out = out.unionByName(own.select("domain", F.lower(strip(F.col("keyword"))).alias("keyword")))
    return out.where(F.col("keyword").isNotNull() & is_keyword(F.col("keyword"))).distinct()


def keyword_sets(words: DataFrame) -> DataFrame:
    """(domain, words): the keywords of each domain as one array, written once, broadcast if it is checked to be small."""
    sets = words.where("domain is not null and keyword is not null").groupBy("domain").agg(F.array_sort(F.collect_set("keyword")).alias("words"))
    return sized_broadcast(sets, "keywords", most_rows=10_000)


def filter_lines(docs: DataFrame, domain: Column, text_col: str, words: DataFrame) -> DataFrame:
    """`docs` with the lines that hold a keyword of their domain (or of 'global'), or a watermark, dropped; blank ones stay.

    `words` is (domain, keyword), or what `keyword_sets` makes of it. Each domain's keywords are one array (bounded: a
    domain learns at most twenty a run) joined by domain, so a line meets its own domain's keywords only.
    """
    sets = keyword_sets(words) if "keyword" in words.columns else words
    own = sets.select(F.col("domain").alias("__d"), F.col("words").alias("__own"))
    every = sets.where("domain = 'global'").agg(F.first("words").alias("__all"))  # one row
    joined = docs.withColumn("__k", domain).join(own, F.col("__k") == F.col("__d"), "left").join(F.broadcast(every))
    found = F.concat(F.coalesce(F.col("__own"), F.array().cast("array<string>")), F.coalesce(F.col("__all"), F.array().cast("array<string>")))
    joined = joined.withColumn("__w", found).withColumn("__s", _bare_domain(F.col("__k")))
    kept = F.filter(
        lines(F.col(text_col)), lambda x: (strip(x) == "") | ~(let(F.lower(x), lambda low: F.exists(F.col("__w"), lambda k: F.contains(low, k))) | _watermark(x, F.col("__s")))
    )
    patterned = F.col("__s").isin(*PATTERNS)
    clean = F.when((F.size("__w") == 0) & ~patterned, F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn(text_col, clean).drop("__k", "__d", "__own", "__all", "__w", "__s")


def merge_keywords(old: DataFrame, new: DataFrame) -> DataFrame:
    """(domain, keywords): union of both, sorted, one row a domain."""
    both = old.select("domain", "keyword").unionByName(new.select("domain", "keyword")).distinct()
    return both.groupBy("domain").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))
