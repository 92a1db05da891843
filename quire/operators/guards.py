"""Guards of a walk through a story as set and window queries: duplicates, visits, failure streaks, rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import fingerprint


def duplicates(docs: DataFrame, text_col: str, order: list[str], within: list[str] | None = None, bucket: Column | None = None) -> DataFrame:
    """`docs` with fp and copy_no: the first of equal texts (within the given columns) has 1. Null texts have null in both.

    The hash is taken before the exchange. See `copies` for `bucket`.
    """
    return copies(docs.withColumn("fp", fingerprint(F.col(text_col))), order, within, bucket)


def copies(rows: DataFrame, order: list[str], within: list[str] | None = None, bucket: Column | None = None) -> DataFrame:
    """`rows` with copy_no: the first row of an equal fp (within the given columns) has 1; null where fp is null.

    `bucket`, a column that never falls along `order`, splits a fingerprint with very many copies: copies are ranked
    within buckets, and a bucket starts at the number of copies in the buckets before it. It reads `rows` twice, so give
    it narrow rows that are written or cheap.
    """
    keys, columns = [*(within or []), "fp"], rows.columns
    if bucket is None:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return rows.withColumn("copy_no", F.when(F.col("fp").isNotNull(), rank))
    rows = rows.withColumn("__b", bucket)
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.where("fp is not null").groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    offsets = counts.withColumn("__o", F.coalesce(F.sum("__n").over(before), F.lit(0))).where("__o > 0").drop("__n")
    rank = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*order))
    joined = rows.withColumn("__r", rank).join(offsets, [*keys, "__b"], "left")
    return joined.withColumn("copy_no", F.when(F.col("fp").isNotNull(), F.col("__r") + F.coalesce("__o", F.lit(0)))).select(*columns, "copy_no")


def until_repeat(docs: DataFrame, story: str, index: str, fp: str) -> DataFrame:
    """Rows of each story before the first whose text occurred in it before: a walk stops at a repeat."""
    seen = Window.partitionBy(story, fp).orderBy(index)
    rows = docs.withColumn("__again", F.when(F.row_number().over(seen) > 1, F.col(index)))
    whole = Window.partitionBy(story)
    return rows.withColumn("__stop", F.min("__again").over(whole)).where(F.col("__stop").isNull() | (F.col(index) < F.col("__stop"))).drop("__again", "__stop")


def streaks(events: DataFrame, key: str, order: list[str], failed: Column, bucket: Column | None = None) -> DataFrame:
    """`events` with streak: how many failures in a row end here (0 for a success).

    `bucket`, a column that never falls along `order` (the day, say), splits keys with very many events: runs are counted
    within buckets, and a bucket's first run goes on from the failures that end the buckets before it.
    """
    rows = events.withColumn("__f", failed.cast("int")).withColumn("__b", F.lit(0) if bucket is None else bucket)
    by = Window.partitionBy(key, "__b").orderBy(*order)
    rows = rows.withColumn("__g", F.sum(1 - F.col("__f")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run = Window.partitionBy(key, "__b", "__g").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("streak", F.sum("__f").over(run))
    if bucket is None:
        return rows.drop("__f", "__g", "__b")
    runs = rows.groupBy(key, "__b", "__g").agg(F.sum("__f").alias("n"))
    ends = runs.groupBy(key, "__b").agg(F.max_by("n", "__g").alias("tail"), (F.max("__g") > 0).cast("int").alias("ok"))
    along = Window.partitionBy(key).orderBy("__b")
    ends = ends.withColumn("part", F.sum("ok").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    since = Window.partitionBy(key, "part").orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ends.withColumn("so_far", F.sum("tail").over(since))
    carried = ends.select(key, "__b", F.coalesce(F.lag("so_far").over(along), F.lit(0)).alias("__c")).where("__c > 0")
    out = rows.join(carried, [key, "__b"], "left")
    more = F.when((F.col("__g") == 0) & (F.col("__f") == 1), F.coalesce("__c", F.lit(0))).otherwise(0)
    return out.withColumn("streak", F.col("streak") + more).select(*events.columns, "streak")


def trailing_count(events: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """`events` with recent: events of the key in the trailing window, itself included, the far edge excluded.

    Time is cut into slots of the window's length; every event stands in its own slot and, to be counted only, in the
    next. A frame never reaches further, so a key with very many events is spread over its slots.
    """
    span = seconds * 1_000_000
    rows = events.withColumn("__m", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("__s", F.floor(F.col("__m") / F.lit(span)))
    both = rows.withColumn("__k", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("__s", F.col("__s") + F.col("__k"))
    by = Window.partitionBy(key, "__s").orderBy("__m").rangeBetween(-(span - 1), 0)
    return both.withColumn("recent", F.count("*").over(by)).where("__k = 0").select(*events.columns, "recent")


def walk(links: DataFrame, starts: DataFrame, most: int = 5000) -> DataFrame:
    """(start, step, url): pages reached by following next links from each start, each visited once.

    `links` is (url, next_url), `starts` (url); of several next links the least counts. A walk ends at a page without a
    row, at a page it has visited, or after `most` steps. By doubling: a round knows where 2^k steps lead from every page
    and adds that many steps to every walk, so a walk of n steps takes log2(n) rounds. A walk that comes back to a page
    keeps the first visit, and all after it are repeats. Rounds are written to the shared folder.
    """
    from quire.operators.shared import materialize

    jump = links.where("next_url is not null").groupBy("url").agg(F.min("next_url").alias("to"))
    visited, known, reach = starts.select(F.col("url").alias("start"), F.lit(0).alias("step"), "url").distinct(), -1, 1
    visited = materialize(visited, "walk")
    while (count := visited.count()) > known and reach <= most:
        jump, known = materialize(jump, "jump"), count
        moved = visited.join(jump, "url").select("start", (F.col("step") + reach).alias("step"), F.col("to").alias("url"))
        both = visited.unionByName(moved.where(F.col("step") <= most))
        visited = materialize(both.groupBy("start", "url").agg(F.min("step").alias("step")).select("start", "step", "url"), "walk")
        after = jump.select(F.col("url").alias("to"), F.col("to").alias("then"))
        jump, reach = jump.join(after, "to").select("url", F.col("then").alias("to")), reach * 2
    return visited


def first_success(results: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First step of each chain whose status is success or fallback, else its last step: one row a key."""
    ok = F.col("status").isin("success", "fallback")
    rank = Window.partitionBy(*key).orderBy(F.when(ok, 0).otherwise(1), *(F.when(ok, F.col(c)) for c in order), *(F.desc(c) for c in order))
    return results.withColumn("__r", F.row_number().over(rank)).where("__r = 1").drop("__r")
