"""Problem 1: visually identical text with different characters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.chars import fold, h128, look, per_distinct
from quire.operators.shared import materialize


def consistent_text(df: DataFrame, columns: list[str], suffix: str = "_norm", keep_case: bool = False) -> DataFrame:
    """Add `<column><suffix>` with the consistent form of each text column.

    The form is compatibility-normalised and composed, with look-alike letters and blanks mapped, characters that show
    nothing removed and (unless `keep_case`) case fully folded. Null stays null, an empty text stays empty; other
    columns pass through, but one named as a result is replaced. One Arrow pass, each distinct value of a batch is
    computed once.
    """
    df = df.drop(*(c + suffix for c in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays, names = list(batch.columns), list(batch.schema.names)
            for c in columns:
                form = per_distinct(batch.column(names.index(c)), look if keep_case else lambda v: fold(look(v)))
                arrays.append(pa.array(form, pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=names + [c + suffix for c in columns])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    schema += "".join(f", `{c}{suffix}` string" for c in columns)
    return df.mapInArrow(run, schema)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, title, text) -> (id, folded key, look key, raw key), 128-bit hashes of the pair of fields."""
    for batch in batches:
        ids, titles, texts = batch.columns
        t = per_distinct(titles, lambda v: (fold(f := look(v)), f, v))
        c = per_distinct(texts, lambda v: (h128(fold(f := look(v))), h128(f), h128(v)))
        keys = [[h128(f"{a[k]}\n{b[k]}") for a, b in zip(t, c, strict=True)] for k in range(3)]
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(k, pa.string()) for k in keys)], names=["id", "folded", "same", "raw"])


def look_keys(df: DataFrame, id_col: str, title_col: str, text_col: str) -> DataFrame:
    """One row per row whose two fields are not null: its id and three keys (folded form, form with case, raw)."""
    chosen = df.select(F.col(id_col).alias("id"), F.col(title_col).alias("title"), F.col(text_col).alias("text"))
    chosen = chosen.where("title is not null and text is not null")
    return chosen.mapInArrow(_keys, f"id {df.schema[id_col].dataType.simpleString()}, folded string, same string, raw string")


def same_looking_pairs(df: DataFrame, id_col: str, title_col: str, text_col: str) -> DataFrame:
    """Pairs (id_a < id_b) of rows whose two fields look the same while at least one differs in its characters.

    Rows with a null in either field pair with none; equal rows pair with none of their copies; a repeated id never
    pairs with itself. Rows are brought together by the folded form, and pairs are kept whose form with case is equal.
    Work follows the result: groups with one spelling end at an aggregation, and pairs are formed between the distinct
    spellings of a group first, so a group of many exact copies never meets itself. The keys (about a hundred bytes a
    row) are written once to the shared folder, as four exchanges read them.
    """
    keys = materialize(look_keys(df, id_col, title_col, text_col), "p1-keys")
    spelt = keys.groupBy("folded", "same", "raw").agg(F.lit(1).alias("one")).drop("one")
    several = (
        spelt.groupBy("folded", "same")
        .agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
        .where("lo < hi")
        .select("folded", "same")
    )
    spellings = spelt.join(several, ["folded", "same"], "left_semi")
    a, b = spellings.alias("a"), spellings.alias("b")
    pairs = a.join(
        b, (F.col("a.folded") == F.col("b.folded")) & (F.col("a.same") == F.col("b.same")) & (F.col("a.raw") < F.col("b.raw"))
    ).select(F.col("a.raw").alias("raw_a"), F.col("b.raw").alias("raw_b"))
    rows = keys.select("id", "raw")
    left = rows.select(F.col("id").alias("x"), F.col("raw").alias("raw_a"))
    right = rows.select(F.col("id").alias("y"), F.col("raw").alias("raw_b"))
    return (
        pairs.join(left, "raw_a")
        .join(right, "raw_b")
        .where("x <> y")
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        .distinct()
    )
