"""Problem 7: filling containers of fixed capacity by vector bin packing with the dot-product heuristic."""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.shared import materialize

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


class TokenCounter:
    """Exact token counts of a byte-level BPE. Its pre-tokens are independent, so each distinct one is encoded once."""

    def __init__(self, path: str):
        import regex

        self.tokenizer = _tokenizer(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)["pre_tokenizer"]["type"]
        if kind != "ByteLevel":
            raise ValueError(f"{path}: a byte-level BPE is needed, not {kind}")
        # Fixed value: the pre-token pattern of byte-level BPE, part of the public vocabulary's definition.
        self.pattern = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        known, split = self.known, [Counter(self.pattern.findall(t)) for t in texts]
        new = list({w for words in split for w in words if w not in known})
        for w, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
            known[w] = len(e.ids)
        out = [sum(known[w] * n for w, n in words.items()) for words in split]
        if len(known) > 500_000:  # bounds the memory of a long partition
            known.clear()
        return out


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, tokens, loss): size of each text in tokens of a public tokenizer, and how many of them bear loss.

    The first paragraph of a text of several is its prompt and bears none. A null text has nulls, '' has 0.
    """
    path = os.path.join(tokenizers, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = TokenCounter(path)
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            texts = coded.dictionary.to_pylist()
            sizes: list[int] = []
            prompts: list[int] = []
            for i in range(0, len(texts), 256):
                part = texts[i : i + 256]
                sizes += counter.counts(part)
                prompts += counter.counts([t[:k] if (k := t.find("\n\n")) > 0 else "" for t in part])
            at = coded.indices.to_pylist()
            out = [None if k is None else sizes[k] for k in at]
            loss = [None if k is None else max(0, sizes[k] - prompts[k]) for k in at]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int32()), pa.array(loss, pa.int32())], names=["id", "tokens", "loss"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, tokens int, loss int")


def place(sizes: np.ndarray, capacity: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Container of each item: vector bin packing by the dot-product heuristic, one open container at a time.

    `sizes` (items x limits) and `capacity` (limits) are whole numbers; every item must fit alone. The next item is the
    one that fits and whose sizes have the largest weighted dot product with what the container has left; weights are
    by default the share of each limit that all items together need. Equal items are kept as one kind with a number of
    copies, so a step looks at the distinct kinds only.
    """
    n = len(sizes)
    out = np.full(n, -1, dtype=np.int64)
    if n == 0:
        return out
    kinds, which = np.unique(sizes, axis=0, return_inverse=True)
    which = which.reshape(-1)
    order = np.argsort(which, kind="stable")
    left = np.bincount(which, minlength=len(kinds))
    taken = np.concatenate(([0], np.cumsum(left)))[:-1].copy()
    load = sizes.sum(axis=0) / np.maximum(capacity, 1)
    w = load / max(load.max(), 1e-12) if weights is None else np.asarray(weights, dtype=float)
    w = w / np.maximum(capacity, 1).astype(float) ** 2
    weighted = kinds * w
    largest = np.argsort(-(weighted @ capacity.astype(float)), kind="stable")
    weighted, kinds, left, taken = weighted[largest], kinds[largest], left[largest], taken[largest]
    container = done = 0
    room = capacity.astype(np.int64).copy()
    columns = [(np.ascontiguousarray(kinds[:, j]), np.ascontiguousarray(weighted[:, j])) for j in range(kinds.shape[1])]
    while done < n:
        value = np.where(left > 0, 0.0, -np.inf)
        for j, (size, weight) in enumerate(columns):
            value += weight * float(room[j])
            value[size > room[j]] = -np.inf
        k = int(np.argmax(value))
        if value[k] == -np.inf:
            container += 1
            room = capacity.astype(np.int64).copy()
            keep = left > 0
            left, taken = left[keep], taken[keep]
            columns = [(size[keep], weight[keep]) for size, weight in columns]
            continue
        out[order[taken[k]]] = container
        taken[k] += 1
        left[k] -= 1
        for j, (size, _) in enumerate(columns):
            room[j] -= size[k]
        done += 1
    return out


def pack(
    items: DataFrame,
    targets: DataFrame,
    id_col: str,
    tokens_col: str,
    loss_col: str | None = None,
    max_segments: int = 64,
    loss_limit: float = 0.99,
    lot: int = 4096,
) -> DataFrame:
    """Assign items to containers of each target's capacity under three limits at once.

    The limits are tokens (`capacity_tokens`), segments (`max_segments`) and loss-bearing tokens (`loss_limit` of the
    capacity; `loss_col` holds an item's number of them, null counts as none, without it none are counted). An item that exceeds a limit by
    itself is split into the fewest parts of equal share of loss that do not, each as large as the limits let it be but
    the last; no other is split. Result: target_id, container, id, part (from 1), tokens, loss. Items of null or zero
    size take no room and have no row. Targets are a stated, short list.

    Items are dealt to lots by a hash of their id, about `lot` of them each, and packed lot by lot; only the last few
    containers of a lot are not full, which costs well under one container in a hundred. No lot grows with the data or
    with a source, so no task does.
    """
    loss = F.lit(0) if loss_col is None else F.least(F.coalesce(F.col(loss_col), F.lit(0)), F.col(tokens_col))
    sized = items.select(F.col(id_col).alias("id"), F.col(tokens_col).cast("long").alias("all"), loss.cast("long").alias("bears")).where("all > 0")
    sized = materialize(sized, "p7-sizes")  # counted and packed: the tokenizer runs once
    wanted = targets.select("target_id", F.col("capacity_tokens").cast("long").alias("cap")).where("cap > 0").collect()
    count = max(1, -(-sized.count() // lot))
    tid = targets.schema["target_id"].dataType.simpleString()
    each = F.array(*(F.struct(F.lit(t.target_id).cast(tid).alias("target_id"), F.lit(t.cap).cast("long").alias("cap")) for t in wanted))
    each = each if wanted else F.from_json(F.lit("[]"), f"array<struct<target_id:{tid},cap:bigint>>")
    pieces = sized.withColumn("t", F.explode(each)).select("id", "all", "bears", "t.target_id", "t.cap")
    # the most tokens of this item that keep both limits; its loss is spread evenly, rounded up
    most = F.floor(F.floor(F.col("cap") * F.lit(float(loss_limit))) * F.col("all") / F.greatest(F.col("bears"), F.lit(1)))
    most = F.when(F.col("bears") > 0, F.greatest(F.least(F.col("cap"), most), F.lit(1))).otherwise(F.col("cap"))
    pieces = pieces.withColumn("most", most).withColumn("parts", F.ceil(F.col("all") / F.col("most")).cast("int"))
    pieces = pieces.select("*", F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("part"))
    size = F.least(F.col("most"), F.col("all") - (F.col("part") - 1) * F.col("most"))
    pieces = pieces.select(
        "target_id", "cap", "id", "part", size.alias("tokens"), F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias("lot"), "all", "bears", "most"
    )
    bound = F.floor(F.col("cap") * F.lit(float(loss_limit)))
    share = F.least(F.ceil(F.col("bears") * F.col("tokens") / F.col("all")), F.col("tokens"))
    # a part of one token or a rounding up may touch the bound by one token, never pass it
    pieces = pieces.withColumn("loss", F.least(share, F.greatest(bound, F.lit(1))).cast("long")).drop("all", "bears")
    # a part as large as the limits let it be leaves no room: it is a container by itself
    full = F.col("tokens") == F.col("most")
    alone = pieces.where(full).select(
        "target_id", F.concat_ws("-", F.lit("w"), F.col("id").cast("string"), F.col("part").cast("string")).alias("container"), "id", "part",
        F.col("tokens").cast("int").alias("tokens"), F.col("loss").cast("int").alias("loss"),
    )
    pieces = pieces.where(~full).drop("most")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        cap = int(pdf["cap"].iloc[0])
        pdf = pdf.sort_values(["id", "part"], kind="stable")
        sizes = np.stack([pdf["tokens"].to_numpy(), np.ones(len(pdf), dtype=np.int64), pdf["loss"].to_numpy()], axis=1).astype(np.int64)
        at = place(sizes, np.array([cap, max_segments, max(1, int(cap * loss_limit))]))
        lot_no = str(pdf["lot"].iloc[0])
        return pd.DataFrame(
            {
                "target_id": pdf["target_id"].to_numpy(),
                "container": [f"{lot_no}-{k}" for k in at],
                "id": pdf["id"].to_numpy(),
                "part": pdf["part"].to_numpy(),
                "tokens": pdf["tokens"].to_numpy().astype("int32"),
                "loss": pdf["loss"].to_numpy().astype("int32"),
            }
        )

    kind = items.schema[id_col].dataType.simpleString()
    packed = pieces.groupBy("target_id", "lot").applyInPandas(one, f"target_id {tid}, container string, id {kind}, part int, tokens int, loss int")
    return packed.unionByName(alone)
