"""Fetch results as rows: which of several fetches counts, how a page's run scored, what went wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import is_challenge


def fetched(plain_html: Column, plain_status: Column, browser_html: Column, browser_status: Column, browser_first: Column) -> Column:
    """struct(html, status, method, confidence): the browser's page where a site asks for it; else the plain fetch; the
    browser's where that is missing (0.85), blocked or challenged (0.9). All null where neither gave a page."""
    blocked = (plain_status == 403) | is_challenge(plain_html)

    def choice(html: Column, status: Column, method: str, confidence: float) -> Column:
        return F.struct(html.alias("html"), status.alias("status"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))

    return (
        F.when(F.coalesce(browser_first, F.lit(False)) & browser_html.isNotNull(), choice(browser_html, browser_status, "browser", 1.0))
        .when(plain_html.isNotNull() & ~F.coalesce(blocked, F.lit(False)), choice(plain_html, plain_status, "plain", 1.0))
        .when(browser_html.isNotNull() & plain_html.isNull(), choice(browser_html, browser_status, "browser_fallback", 0.85))
        .when(browser_html.isNotNull(), choice(browser_html, browser_status, "browser_challenge", 0.9))
        .when(plain_html.isNotNull(), choice(plain_html, plain_status, "plain_blocked", 0.0))
    )


def prefer_prefetched(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """`urls` (url) with the page already fetched for each, null where there is none; of several the latest."""
    latest = pages.groupBy("url").agg(F.max_by("html", "fetched_at").alias("html"), F.max("fetched_at").alias("fetched_at"))
    return urls.join(latest, "url", "left")


def pipeline_score(quality: Column, duration_ms: Column, method: Column, confidence: Column, places: int | None = 3) -> Column:
    """struct(quality, speed, resource, confidence, total), rounded to `places` where given."""
    q, c = F.coalesce(quality, F.lit(0.0)), F.coalesce(confidence, F.lit(0.0))
    speed = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) - (F.greatest(F.coalesce(duration_ms, F.lit(0.0)), F.lit(1.0)) - 500) / 4500))
    resource = F.when(F.contains(F.lower(F.coalesce(method, F.lit(""))), F.lit("playwright")), 0.5).otherwise(1.0)
    total = q * 0.4 + speed * 0.3 + resource * 0.2 + c * 0.1
    parts = {"quality": q, "speed": speed, "resource": resource, "confidence": c, "total": total}
    return F.struct(*((v if places is None else F.round(v, places)).alias(k) for k, v in parts.items()))


def issues(contexts: DataFrame) -> DataFrame:
    """(type, url, detail): blocked and missing pages, short contents, titles that are only a number."""
    url = F.col("url")
    status = F.col("status_code").cast("string")
    found = F.array(
        F.when(F.col("status_code") == 429, F.struct(F.lit("rate_limited").alias("type"), status.alias("detail"))),
        F.when(is_challenge(F.col("html")), F.struct(F.lit("blocked").alias("type"), status.alias("detail"))),
        F.when(F.col("html").isNull(), F.struct(F.lit("missing_page").alias("type"), status.alias("detail"))),
        F.when(F.col("content").isNotNull() & (F.length(F.trim("content")) < 100), F.struct(F.lit("short_content").alias("type"), F.length("content").cast("string").alias("detail"))),
        F.when(F.col("title_clean").rlike(r"^Chapter \d+$"), F.struct(F.lit("bare_title").alias("type"), F.col("title_clean").alias("detail"))),
    )
    rows = contexts.select(url.alias("url"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i"))
    return rows.select("i.type", "url", "i.detail")
