"""Problem 8: evaluation texts inside training text, by pigeonhole edit matching."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.chars import look

# Fixed values of the task: a run of so many words (characters without blanks between words) is a leak, and so many of
# them may be replaced.
WORDS, CHARACTERS, BUDGET = 25, 40, 1
REPLACED_CHARACTERS = 4  # a replaced word of ideographic text

_TOKEN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ]|(?:(?![぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ])\w)+")
_MARKS = re.compile(r"(?<=\w)[̀-ͯ]+")
_IDEOGRAPHIC = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")


def tokens(text: str) -> list[str]:
    """Words in lower case without punctuation; each Japanese or Chinese character is one."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", look(text))
        text = text.replace("’", "").replace("‘", "")
        text = _join_marks(text)
    return _TOKEN.findall(text.lower().replace("'", "").replace("_", " "))


_COMBINING = re.compile(r"[^\w\s\x00-\x7f]")


def _join_marks(text: str) -> str:
    """Combining vowel signs belong to their word; they are dropped, as on both sides."""
    return _COMBINING.sub(lambda m: "" if unicodedata.category(m.group())[0] == "M" else " ", text)


def is_ideographic(words: list[str]) -> bool:
    return sum(len(w) == 1 and _IDEOGRAPHIC.match(w) is not None for w in words) * 2 > len(words)


def myers(pattern: list[int], text: list[int]) -> list[int]:
    """Edit distance of `pattern` to the best substring of `text` ending at each position (Myers 1999, bit-parallel)."""
    m = len(pattern)
    peq: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = full, 0, m, []
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        out.append(score)
    return out


class Leaks:
    """Index of the pieces of all test items.

    A window of `need` tokens with at most `budget` of them replaced holds, among `budget` + 1 disjoint aligned pieces,
    one that is unchanged. Pieces are so short that every window covers that many whole ones wherever it starts, so the
    disjoint pieces of an item suffice. In ideographic text a replaced word is several characters and may lie across
    two pieces, so one piece more is cut.
    """

    def __init__(self, items: list[tuple[int, str]], words: int = WORDS, characters: int = CHARACTERS, budget: int = BUDGET):
        self.budget = budget
        groups: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for item, passage in items:
            if passage is not None and (t := tuple(tokens(passage))):
                groups[t].append(item)
        self.passages: list[tuple[tuple[str, ...], list[int], int, bool]] = []
        self.pieces: dict[int, dict[tuple[str, ...], list[tuple[int, int]]]] = {}
        for t, ids in groups.items():
            ideographic = is_ideographic(list(t))
            need = min(characters if ideographic else words, len(t))
            parts = budget + 1 + ideographic
            size = max(1, (need + 1) // (parts + 1))  # need >= parts * size + size - 1
            k = len(self.passages)
            self.passages.append((t, ids, need, ideographic))
            table = self.pieces.setdefault(size, {})
            for at in range(0, len(t) - size + 1, size):
                table.setdefault(t[at : at + size], []).append((k, at))
        self.vocabulary = {w for t, *_ in self.passages for w in t}
        # by the last word of a piece: the tables that hold a piece which ends in it
        self.ends: dict[str, list[tuple[int, dict]]] = {}
        for size, table in self.pieces.items():
            for w in {p[-1] for p in table}:
                self.ends.setdefault(w, []).append((size, table))

    def seeds(self, words: list[str]) -> dict[int, set[int]]:
        """Passage -> diagonals (place in the text less place in the passage) of the exact piece hits."""
        found: dict[int, set[int]] = defaultdict(set)
        ends, vocabulary, least = self.ends, self.vocabulary, min(self.pieces, default=0)
        run = 0  # words of the items' vocabulary in a row
        for i, w in enumerate(words, 1):
            if w not in vocabulary:
                run = 0
                continue
            run += 1
            for size, table in ends.get(w, ()) if run >= least else ():
                if run >= size:
                    for k, at in table.get(tuple(words[i - size : i]), ()):
                        found[k].add(i - size - at)
        return found

    def verify(self, words: list[str], k: int, diagonal: int) -> bool:
        """Whether a window of the passage stands here within the budget.

        Myers' distance decides for each window along the diagonal, with the error budget itself as its bound; an exact
        check follows that the errors are replacements (not words put in or left out), in ideographic text of one stretch
        of up to four characters.
        """
        passage, _, need, ideographic = self.passages[k]
        allowed = self.budget * (REPLACED_CHARACTERS if ideographic else 1)
        lo, hi = max(0, -diagonal), min(len(passage), len(words) - diagonal)
        codes: dict[str, int] = {}
        text = [codes.setdefault(w, len(codes)) for w in words[lo + diagonal : hi + diagonal]]
        pattern = [codes.setdefault(w, len(codes)) for w in passage[lo:hi]]
        at = 0
        while at + need <= hi - lo:
            nearby = text[max(0, at - allowed) : at + need + allowed]
            errors = min(myers(pattern[at : at + need], nearby))
            if errors <= allowed:
                wrong = [q for q in range(at, at + need) if pattern[q] != text[q]]
                if len(wrong) <= self.budget or ideographic and wrong[-1] - wrong[0] < allowed:
                    return True
                at = wrong[0] + 1  # every window that still holds the first error has too many
            else:
                at += errors - allowed  # a window further on has at most one error less for each word
        return False

    def search(self, text: str) -> list[int]:
        """Ids of the items that leak into a text, ascending."""
        words = tokens(text)
        out: set[int] = set()
        for k, diagonals in self.seeds(words).items():
            if any(self.verify(words, k, d) for d in diagonals):
                out.update(self.passages[k][1])
        return sorted(out)


def leaked_items(
    df: DataFrame,
    id_col: str,
    text_col: str,
    items: DataFrame,
    item_col: str,
    passage_col: str,
    words: int = WORDS,
    characters: int = CHARACTERS,
    budget: int = BUDGET,
    block: int = 5000,
) -> DataFrame:
    """(id, item_id): the documents that hold a passage, or enough consecutive words of it, and the items they leak.

    The test items are a stated query set: they are read in blocks of at most `block` (ordered by id), each block is
    broadcast and indexed once per task, and every document meets every block. Null passages and texts leak nothing;
    items with equal passages are all reported; a document repeated under one id gives one row per item.
    """
    stated = items.select(F.col(item_col).alias("item_id"), F.col(passage_col).alias("passage")).where("passage is not null")
    rows = [(int(r[0]), r[1]) for r in stated.orderBy("item_id").toLocalIterator()]
    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    kind = df.schema[id_col].dataType.simpleString()
    out = None
    for at in range(0, max(1, len(rows)), block):
        part = df.sparkSession.sparkContext.broadcast(rows[at : at + block])

        def run(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            index = Leaks(part.value, words, characters, budget)
            for batch in batches:
                row, item = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for found in index.search(text):
                        row.append(i)
                        item.append(found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(item, pa.int64())], names=["id", "item_id"]
                )

        one = chosen.mapInArrow(run, f"id {kind}, item_id long")
        out = one if out is None else out.unionByName(one)
    return out.distinct()
