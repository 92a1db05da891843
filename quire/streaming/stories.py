"""Streaming forms: watched folders, duplicate suppression, suspect counters and the state of a story's walk."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from quire.functions.text import fingerprint
from quire.operators.boilerplate import edge_lines
from quire.operators.shared import exists

_BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, folder: str, pattern: str = "*.epub") -> DataFrame:
    """Stream of the files that come into a folder, each content once, whatever its name."""
    files = spark.readStream.format("binaryFile").schema(_BINARY).option("pathGlobFilter", pattern).load(folder)
    return files.withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["sha256"])


def run_inbox(files: DataFrame, process, manifest_path: str, checkpoint: str) -> StreamingQuery:
    """Process each batch of new files, then add them to the manifest: a batch that fails is done again, and files the
    manifest names are passed over."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        if exists(spark, manifest_path):  # a manifest that is there but cannot be read is an error
            df = df.join(spark.read.parquet(manifest_path).select("sha256"), "sha256", "left_anti")
        process(df)
        df.select("sha256", "path", F.current_timestamp().alias("processed_at")).write.mode("append").parquet(manifest_path)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_chapters(stream: DataFrame, story: str, text: str, ts: str, delay: str = "10 days") -> DataFrame:
    """Chapters whose text their story has not shown within the delay; state is dropped behind the watermark."""
    rows = stream.withWatermark(ts, delay).withColumn("fp", fingerprint(F.col(text)))
    return rows.dropDuplicatesWithinWatermark([story, "fp"])


def suspect_counts(stream: DataFrame, domain: Column, text: Column) -> DataFrame:
    """Running count of each domain's edge lines."""
    return edge_lines(stream, domain, text).groupBy("domain", "line").agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, ts: str, key: str, size: str = "60 seconds", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Events of each key in event-time windows; late ones count until the watermark has passed."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return stream.withWatermark(ts, delay).groupBy(w, key).agg(F.count("*").alias("n"))


PROGRESS = "story_id bigint, chapters bigint, streak int, last_url string, stopped boolean, reason string"
_STATE = "chapters bigint, streak int, last_url string, stopped boolean, reason string, seen array<string>"


def progress(stream: DataFrame, most_failures: int = 5, most_chapters: int = 5000) -> DataFrame:
    """State of each story's walk from (story_id, at, url, ok, fp): chapters, failures in a row, where it stands, why it
    stopped ('repeat', 'failures', 'cap'). A stopped story takes no further step. Steps of a batch go by time."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chapters, streak, last, stopped, reason, seen = state.get if state.exists else (0, 0, None, False, None, [])
        known = set(seen)
        rows = pd.concat(list(batches)).sort_values(["at", "url"], kind="stable")
        for url, ok, fp in zip(rows["url"], rows["ok"], rows["fp"], strict=True):
            if stopped:
                break
            if not ok:
                streak += 1
                if streak >= most_failures:
                    stopped, reason = True, "failures"
                continue
            if fp in known:
                stopped, reason = True, "repeat"
                break
            known.add(fp)
            chapters, streak, last = chapters + 1, 0, url
            if chapters >= most_chapters:
                stopped, reason = True, "cap"
        state.update((chapters, streak, last, stopped, reason, sorted(known)))
        yield pd.DataFrame([{"story_id": key[0], "chapters": chapters, "streak": streak, "last_url": last, "stopped": stopped, "reason": reason}])

    return stream.groupBy("story_id").applyInPandasWithState(step, PROGRESS, _STATE, "update", GroupStateTimeout.NoTimeout)
