"""Problem 2: lines repeated across one site's documents, found through fixed-depth token trees."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.chars import codes, fold, h64, is_letter, look, per_distinct
from quire.operators.shared import materialize, sized_broadcast

_BLANKS = re.compile(r"[^\S\n]+")
_DIGITS = re.compile(r"\d+")
SLOT = "\u0000"  # stands for one run of digits
PIECE = 6


class Leaf:
    """A leaf of a tree: its path as a key, the template of the lines that reached it, and in how many rows they stand.

    Where those lines differ beyond the path the template has a wildcard slot (None); merging is by position, so it
    comes out the same in any order.
    """

    __slots__ = ("key", "tokens", "rows", "sample")

    def __init__(self, key: int):
        self.key, self.tokens, self.rows, self.sample = key, None, 0, ""

    def cover(self, tokens: list[str | None], rows: int, sample: str) -> None:
        if self.tokens is None:
            self.tokens, self.sample = list(tokens), sample
        else:
            self.tokens = [a if a == b else None for a, b in zip(self.tokens, tokens, strict=False)]
            self.sample = min(self.sample, sample)
        self.rows += rows


class TokenTree:
    """Lines parsed by a tree of fixed depth: number of tokens -> first tokens -> a leaf with a template of wildcard slots.

    A token is a slot (a run of digits) or a piece of up to six characters of a line that was made consistent, folded
    and freed of blanks, so lines that differ only in case, blanks, digits or look-alike characters walk one path. Trees
    of several partitions merge leaf by leaf: equal paths have equal keys.
    """

    def __init__(self, depth: int = 3):
        self.depth = depth
        self.root: dict = {}
        self.leaves: list[Leaf] = []

    @staticmethod
    def tokens(line: str) -> list[str]:
        out: list[str] = []
        for k, part in enumerate(line.split(SLOT)):
            if k:
                out.append(SLOT)
            out += [part[i : i + PIECE] for i in range(0, len(part), PIECE)]
        return out

    def leaf(self, tokens: list[str]) -> Leaf:
        """The leaf where a line ends; the path is laid where it is new."""
        node = self.root.get(len(tokens))
        if node is None:
            node = self.root[len(tokens)] = {}
        for t in tokens[: self.depth]:
            below = node.get(t)
            if below is None:
                below = node[t] = {}
            node = below
        end = node.get(None)
        if end is None:
            end = node[None] = Leaf(h64("\x01".join((str(len(tokens)), *tokens[: self.depth]))))
            self.leaves.append(end)
        return end


def normal_lines(text: str) -> list[str]:
    """The lines of a text in the form whose equality makes them the same line; as many as split at each line feed."""
    return _DIGITS.sub(SLOT, _BLANKS.sub("", fold(look(text)))).split("\n")


def letters_per_line(texts: list[str]) -> list[list[int]]:
    """Letters and combining marks in each line of each text, before any normalising."""
    at = codes("\n".join(texts))
    ends = np.flatnonzero(at == 10)
    total = np.concatenate(([0], np.cumsum(is_letter()[at])))
    counts = np.diff(np.concatenate(([0], total[ends], [total[-1]]))).tolist()
    out, i = [], 0
    for t in texts:
        n = t.count("\n") + 1
        out.append(counts[i : i + n])
        i += n
    return out


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, site, text) -> one row per line with letters: where it ended in the tree, its kind, place and letters.

    `new` is 2 where the row reaches the leaf for the first time, 1 where it only shows another kind for the first time.
    """
    names = ["site", "leaf", "kind", "id", "line_no", "letters", "new"]
    for batch in batches:
        texts = batch.column(2).to_pylist()
        letters = letters_per_line(texts)
        tree = TokenTree()  # paths do not depend on the site, so one tree serves the batch
        known: dict[str, tuple[int, int]] = {}
        row: list[int] = []
        at: list[tuple[int, int]] = []
        line_no: list[int] = []
        many: list[int] = []
        new: list[int] = []
        for i, lines in enumerate(per_distinct(batch.column(2), normal_lines)):
            leaves, kinds = set(), set()
            for no, (line, n) in enumerate(zip(lines, letters[i], strict=True), 1):
                if n:
                    k = known.get(line)
                    if k is None:
                        k = known[line] = (tree.leaf(TokenTree.tokens(line)).key, h64(line))
                    row.append(i)
                    at.append(k)
                    line_no.append(no)
                    many.append(n)
                    new.append(2 if k[0] not in leaves else 1 if k[1] not in kinds else 0)
                    leaves.add(k[0])
                    kinds.add(k[1])
        take = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(1).take(take),
                pa.array([k[0] for k in at], pa.int64()),
                pa.array([k[1] for k in at], pa.int64()),
                batch.column(0).take(take),
                pa.array(line_no, pa.int32()),
                pa.array(many, pa.int32()),
                pa.array(new, pa.int8()),
            ],
            names=names,
        )


def _sited(df: DataFrame, site: Column, text_col: str, *more: Column) -> DataFrame:
    chosen = df.select(*more, F.coalesce(site, F.lit("")).alias("site"), F.col(text_col).alias("text"))
    return chosen.where("text is not null")


def site_lines(df: DataFrame, id_col: str, site: Column, text_col: str) -> DataFrame:
    """One row per line with letters of each non-null text: site, leaf (hash of the tree path), kind (hash of the line
    with its digits as slots), id, line_no, letters, new."""
    kind = df.schema[id_col].dataType.simpleString()
    chosen = _sited(df, site, text_col, F.col(id_col).alias("id")).select("id", "site", "text")
    return chosen.mapInArrow(_lines, f"site string, leaf long, kind long, id {kind}, line_no int, letters int, new byte")


def _covering(counts: DataFrame, totals: DataFrame, min_rows: int, min_share: float) -> DataFrame:
    """The counts (with `site` and `rows`) of at least `min_rows` rows and `min_share` of a site's rows."""
    return counts.where(F.col("rows") >= min_rows).join(totals, "site").where(F.col("rows") >= F.lit(min_share) * F.col("total"))


def repeated_lines(
    df: DataFrame, id_col: str, site: Column, text_col: str, min_rows: int = 5, min_share: float = 0.05, min_letters: int = 15
) -> DataFrame:
    """(id, line_no) of each line whose template its site puts into many of its rows.

    Lines end in the leaves of token trees; the trees of all partitions are merged by adding the rows of equal leaves of
    a site, and leaves that cover many rows are kept. A leaf's template may have slots that take other words, while
    lines are the same here only up to digits: an exact check follows, which counts the kinds within the kept leaves.
    A leaf and a kind count once per row; a row is one row of `df` with non-null text, repeated rows count each. Texts
    without a site form the site ''. All rows are counted, pre-aggregated before each exchange; the lines' hashes are
    written once to the shared folder, as several passes read them. At most 1 / `min_share` leaves for each line of an
    average row are kept per site; they are broadcast where their number is checked to be small, else shuffled.
    """
    lines = materialize(site_lines(df, id_col, site, text_col), "p2-lines")
    totals = _sited(df, site, text_col).groupBy("site").agg(F.count("*").alias("total"))
    leaves = lines.where("new = 2").groupBy("site", "leaf").agg(F.count("*").alias("rows"))
    kept = sized_broadcast(_covering(leaves, totals, min_rows, min_share).select("site", "leaf", "total"), "p2-leaves")
    within = lines.join(kept, ["site", "leaf"])
    kinds = within.where("new > 0").groupBy("site", "kind").agg(F.count("*").alias("rows"), F.first("total").alias("total"))
    same = kinds.where((F.col("rows") >= min_rows) & (F.col("rows") >= F.lit(min_share) * F.col("total")))
    same = sized_broadcast(same.select("site", "kind"), "p2-kinds")
    return within.where(F.col("letters") >= min_letters).join(same, ["site", "kind"], "left_semi").select("id", "line_no")


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, text) -> the leaves of one token tree per site and batch: key, template, a sample line, rows."""
    for batch in batches:
        trees: dict[str, TokenTree] = {}
        for site, text, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), per_distinct(batch.column(1), normal_lines), strict=True):
            tree = trees.setdefault(site, TokenTree())
            raw = text.split("\n")
            seen = set()
            for line, k in {line: k for k, line in enumerate(lines)}.items():
                if line.replace(SLOT, ""):
                    tokens = TokenTree.tokens(line)
                    leaf = tree.leaf(tokens)
                    leaf.cover(tokens, int(leaf.key not in seen), raw[k])
                    seen.add(leaf.key)
        rows = [(s, x.key, x.tokens, x.sample, x.rows) for s, tree in trees.items() for x in tree.leaves]
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.int64())
        arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["site", "leaf", "template", "sample", "rows"])


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """The templates of one leaf of one site, at most one a batch, merged."""
    leaf = Leaf(0)
    for template, sample in zip(pdf["template"], pdf["sample"], strict=True):
        leaf.cover(template, 0, sample)
    text = "".join("<*>" if t is None or t == SLOT else t for t in leaf.tokens)
    return pd.DataFrame({"site": [pdf["site"].iloc[0]], "template": [re.sub(r"(?:<\*>)+", "<*>", text)], "sample": [leaf.sample], "rows": [pdf["all"].iloc[0]], "total": [pdf["total"].iloc[0]]})


def line_templates(df: DataFrame, site: Column, text_col: str, min_rows: int = 5, min_share: float = 0.05) -> DataFrame:
    """The templates that cover many documents of their site: site, template (slots as <*>), a sample line, rows, share.

    Each batch builds its trees. Trees merge leaf by leaf: rows are added first, and only of the leaves that cover many
    documents the templates (at most one a batch) are brought together and merged.
    """
    texts = _sited(df, site, text_col)
    trees = materialize(texts.mapInArrow(_trees, "site string, leaf long, template array<string>, sample string, rows long"), "p2-trees")
    totals = texts.groupBy("site").agg(F.count("*").alias("total"))
    leaves = trees.groupBy("site", "leaf").agg(F.sum("rows").alias("rows"))
    kept = sized_broadcast(_covering(leaves, totals, min_rows, min_share).select("site", "leaf", F.col("rows").alias("all"), "total"), "p2-leaves")
    merged = trees.join(kept, ["site", "leaf"]).groupBy("site", "leaf").applyInPandas(_merged, "site string, template string, sample string, rows long, total long")
    return merged.select("site", "template", "sample", "rows", F.round(F.col("rows") / F.col("total"), 4).alias("share"))


def drop_lines(df: DataFrame, id_col: str, text_col: str, lines: DataFrame, out_col: str) -> DataFrame:
    """`df` with `out_col`: the text without the given (id, line_no); all other columns as they are.

    Texts without such lines, and null texts, stay as they are.
    """
    numbers = lines.groupBy(F.col("id").alias("__id")).agg(F.collect_set("line_no").alias("__drop"))
    joined = df.join(numbers, F.col(id_col) == F.col("__id"), "left").drop("__id")
    kept = F.filter(
        F.transform(F.split(F.col(text_col), "\n", -1), lambda line, i: F.struct(line.alias("line"), (i + 1).cast("int").alias("no"))),
        lambda x: ~F.array_contains(F.col("__drop"), x["no"]),
    )
    text = F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    return joined.withColumn(out_col, text).drop("__drop")
