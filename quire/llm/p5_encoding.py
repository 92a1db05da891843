"""Problem 5: garbled text from a wrong character encoding, found by corpus mutual information and undone in place."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.chars import LOOK_ALIKE, codes, look
from quire.llm.chars import TABLE as LOOK_TABLE

# Symbols: each character of these ranges is its own; others stand for their block of 1024, ideographs of the first levels
# of the national sets apart from the rare ones that wrong decodings show. So the table of pairs has a proven size bound
# whatever the corpus holds.
_OWN = [
    (0x0000, 0x0460), (0x0900, 0x0980), (0x0E00, 0x0E80), (0x1EA0, 0x1F00), (0x2000, 0x2070),
    (0x20A0, 0x20B0), (0x2100, 0x2130), (0x2200, 0x2270), (0x2500, 0x25A0), (0x3000, 0x3100),
]
_BLOCK, _TOP = 1024, 0x30000
_HAN_BLOCKS = (0xA000 - 0x3400) // _BLOCK
SYMBOLS = sum(h - low for low, h in _OWN) + _TOP // _BLOCK + _HAN_BLOCKS + 2


def _everyday() -> list[int]:
    """Ideographs of the first level of GB 2312, Big5 and JIS X 0208, as the codecs lay them out."""
    out: set[str] = set()
    for name, leads, trails in (("gb2312", range(0xB0, 0xD8), range(0xA1, 0xFF)), ("big5", range(0xA4, 0xC7), (*range(0x40, 0x7F), *range(0xA1, 0xFF))), ("euc_jp", range(0xB0, 0xD0), range(0xA1, 0xFF))):
        for a in leads:
            for b in trails:
                out.update(bytes((a, b)).decode(name, "ignore"))
    return [ord(c) for c in out if 0x3400 <= ord(c) < 0xA000]


def _symbols() -> np.ndarray:
    table = np.full(0x110000, SYMBOLS - 2, dtype=np.int32)
    n = sum(h - low for low, h in _OWN)
    table[:_TOP] = n + np.arange(_TOP) // _BLOCK
    usual = np.array(_everyday())
    table[usual] = n + _TOP // _BLOCK + (usual - 0x3400) // _BLOCK
    k = 0
    for low, high in _OWN:
        table[low:high] = np.arange(k, k + high - low)
        k += high - low
    table[0xFFFD] = SYMBOLS - 1
    return table


# Bits that tell a character from the others of its symbol.
WITHIN = np.zeros(SYMBOLS, dtype=np.float32)
WITHIN[sum(h - low for low, h in _OWN) :] = 5.0

_TABLE: np.ndarray | None = None


def symbols(at: np.ndarray) -> np.ndarray:
    """Symbol of each code point."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _symbols()
    return _TABLE[at]


def _sloppy(name: str) -> dict[int, int]:
    """Characters of a single-byte encoding to bytes; bytes it leaves undefined pass as control characters."""
    out = {}
    for byte in range(256):
        try:
            c = bytes([byte]).decode(name)
        except UnicodeDecodeError:
            c = chr(byte)
        out[ord(c)] = byte
    return out


# Encodings texts are wrongly read with, the byte each character stands for.
_WRONG = {name: _sloppy(name) for name in ("cp1252", "cp1251", "mac_roman", "cp437", "koi8_r", "cp850", "cp866", "cp1250", "cp1258", "cp874", "iso8859_5")}
for _byte in range(0x80, 0x100):  # Latin-1 beside cp1252, as browsers and repair chains mix them
    _WRONG["cp1252"].setdefault(_byte, _byte)


def _bytes(text: str, table: dict[int, int]) -> bytes | None:
    try:
        return bytes([table[ord(c)] for c in text])
    except KeyError:
        return None


class Doubt:
    """Marks runs of non-ASCII characters that are strict UTF-8 once a wrong single-byte encoding is undone.

    Sound text holds next to no such run, whatever its language. Whether a distinct run is one is decided once.
    """

    _FROM = ("cp1252", "cp1251", "mac_roman", "cp850", "cp1250", "cp1258", "cp437")

    def __init__(self, keep: int = 500_000):
        self.keep, self.known = keep, {}
        self.kinds = []
        for name in self._FROM:
            kind = np.zeros(0x10000, dtype=np.uint8)  # 1 trail byte, 2 lead byte of UTF-8
            for c, byte in _WRONG[name].items():
                kind[c] = 1 if 0x80 <= byte <= 0xBF else 2 if 0xC2 <= byte <= 0xF4 else 0
            kind[:0x80] = 0
            self.kinds.append(kind)

    def _invertible(self, run: str) -> bool:
        for name in self._FROM:
            raw = _bytes(run, _WRONG[name])
            if raw is not None:
                try:
                    raw.decode("utf-8")
                    return True
                except UnicodeDecodeError:
                    pass
        return False

    def mark(self, text: str, at: np.ndarray) -> np.ndarray | None:
        """Whether each character belongs to such a run; None where none does."""
        high = np.flatnonzero(at > 127)
        if len(high) < 2:
            return None
        small = np.minimum(at[high], 0xFFFF)
        beside = np.diff(high) == 1
        hit = np.zeros(len(high) - 1, dtype=bool)
        for kind in self.kinds:
            k = kind[small]
            hit |= (k[:-1] == 2) & (k[1:] == 1)
        hit &= beside
        if not hit.any():
            return None
        starts = np.flatnonzero(np.concatenate(([True], ~beside)))
        ends = np.concatenate((starts[1:], [len(high)]))
        runs = np.unique(np.searchsorted(starts, np.flatnonzero(hit), side="right") - 1)
        out = np.zeros(len(at), dtype=bool)
        for a, b in zip(high[starts[runs]].tolist(), (high[ends[runs] - 1] + 1).tolist(), strict=True):
            run = text[a:b]
            bad = self.known.get(run)
            if bad is None:
                if len(self.known) >= self.keep:
                    self.known.clear()
                bad = self.known[run] = self._invertible(run)
            if bad:
                out[a:b] = True
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> counts of adjacent symbol pairs, summed within the partition before anything is sent.

    Pairs that touch a run which reads as UTF-8 in a wrong encoding are left out, so garbled text that is common does
    not make its own pairs look probable.
    """
    total = np.zeros(SYMBOLS * SYMBOLS, dtype=np.int64)
    doubt = Doubt()
    for batch in batches:
        parts = [t for col in batch.columns for t in col.to_pylist() if t]
        size, first = 0, 0
        for k, t in enumerate(parts, 1):  # parts of a few million characters bound the memory
            size += len(t)
            if size > 4_000_000 or k == len(parts):
                text = "\n" + "\n".join(parts[first:k]) + "\n"
                at = codes(text)
                s = symbols(at).astype(np.int64)
                pair = s[:-1] * SYMBOLS + s[1:]
                out = doubt.mark(text, at)
                if out is not None:
                    pair = pair[~(out[:-1] | out[1:])]
                total += np.bincount(pair, minlength=len(total))
                size, first = 0, k
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["pair", "n"])


def pair_counts(df: DataFrame, text_cols: list[str]) -> DataFrame:
    """(pair, n): how often two symbols stand side by side, over all rows. At most SYMBOLS squared rows."""
    partial = df.select(*text_cols).mapInArrow(_count, "pair long, n long")
    return partial.groupBy("pair").agg(F.sum("n").alias("n"))


class Model:
    """Adjacent pairs scored by mutual information with the corpus, discounted where support is small.

    score = discount x (1 + max(0, pointwise mutual information)); the discount of Pantel and Lin uses a constant that
    is a share of the corpus, so scores are alike at every size. `bits` is the code length of a pair given its first
    symbol, used to compare a run with its decoded form.
    """

    def __init__(self, pair: np.ndarray, n: np.ndarray, share: float = 5e-5):
        self.table = np.zeros((SYMBOLS, SYMBOLS), dtype=np.float32)
        a, b = pair // SYMBOLS, pair % SYMBOLS
        total = max(1.0, float(n.sum()))
        first = np.bincount(a, weights=n, minlength=SYMBOLS)
        second = np.bincount(b, weights=n, minlength=SYMBOLS)
        c = max(1e-9, share * total)
        least = np.minimum(first[a], second[b])
        discount = n / (n + c) * least / (least + c)
        mutual = np.log2(np.maximum(n * total / np.maximum(first[a] * second[b], 1), 1e-12))
        self.table[a, b] = discount * (1 + np.maximum(0, mutual))
        # add-a-share smoothing towards the symbol's own frequency
        alpha = c
        self.alpha_log = np.log2((alpha * (second + 0.5) / (total + 0.5 * SYMBOLS)) + 1e-12).astype(np.float32)
        self.first_log = np.log2(first + alpha).astype(np.float32)
        self.bits_table = (self.first_log[:, None] - self.alpha_log[None, :]).astype(np.float32)
        seen = np.log2(n + alpha * (second[b] + 0.5) / (total + 0.5 * SYMBOLS))
        self.bits_table[a, b] = self.first_log[a] - seen
        self.bits_table += WITHIN[None, :]

    def between(self, before: str, after: str, text: str) -> float:
        """Code length of a text between two characters."""
        s = symbols(codes(before + text + after))
        return float(self.bits_table[s[:-1], s[1:]].sum())

    def bits(self, text: str) -> float:
        """Code length of a text that stands between line feeds."""
        s = symbols(codes(f"\n{text}\n"))
        return float(self.bits_table[s[:-1], s[1:]].sum())

    def gains(self, lines: list[str], tau: float = 0.6) -> np.ndarray:
        """Weight of the maximum-scoring segment of improbable pairs of each line, all lines at once."""
        at = codes("\n" + "\n".join(lines) + "\n")
        s = symbols(at)
        w = (tau - self.table[s[:-1], s[1:]]).astype(np.float64)
        plain = (at[:-1] < 128) & (at[1:] < 128)
        w[plain] = np.minimum(w[plain], 0.0)
        feeds = np.flatnonzero(at == 10)
        total = np.cumsum(w)
        fall = np.zeros(len(w))
        fall[feeds[:-1]] = -1e6  # a line's segment never reaches into the line before
        base = np.cumsum(fall)
        low = np.minimum.accumulate(np.concatenate(([0.0], total[:-1])) + base)
        gain = total + base - low
        return np.maximum.reduceat(gain, feeds[:-1])

    def segments(self, line: str, tau: float = 0.6) -> list[tuple[int, int]]:
        """All maximal-scoring segments (Ruzzo and Tompa 1999) of improbable pairs, as character ranges of the line."""
        at = codes(f"\n{line}\n")
        s = symbols(at)
        w = (tau - self.table[s[:-1], s[1:]]).astype(np.float64)
        plain = (at[:-1] < 128) & (at[1:] < 128)
        w[plain] = np.minimum(w[plain], 0.0)
        stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
        run = 0.0
        for i, x in enumerate(w.tolist()):
            before, run = run, run + x
            if x <= 0:
                continue
            start, left = i, before
            j = len(stack) - 1
            while True:
                while j >= 0 and stack[j][2] >= left:
                    j -= 1
                if j < 0 or stack[j][3] >= run:
                    break
                start, left = stack[j][0], stack[j][2]
                del stack[j:]
                j -= 1
            stack = stack[: j + 1] if j + 1 < len(stack) and stack[j + 1][0] >= start else stack
            stack.append((start, i + 1, left, run))
        return [(max(0, a - 1), min(len(line), b)) for a, b, _, _ in stack]


_WIDE = ("gb18030", "cp932", "big5")
_RIGHT = ("utf-8", "gb18030", "cp932", "cp1251", "koi8_r", "cp874", "cp1252", "big5", "euc_kr", "euc_jp", "cp1258", "cp866")
_DOUBLE = ("gb18030", "cp932", "big5", "euc_kr", "euc_jp")
_UTF8_READ_AS = ("cp1252", "cp1251", "mac_roman", "cp437", "cp850", "koi8_r", "cp866")
# Characters that look like others, to them; width forms to their letters.
_LOOKS = {**LOOK_TABLE, **{c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}}
_NON_ASCII = re.compile(r"[^\x00-\x7f]")
CERTAIN = re.compile("[�\x80-\x84\x86-\x9f]|ï¿½|â€")
_MIXED = re.compile(r"[A-Za-z][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-z]")  # scripts that do not meet within a word
_HAN = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")
_HIGH = re.compile(r"[^\x00-\x7f]+")


def _telling(run: str) -> bool:
    """Whether a run holds anything besides look-alikes, width forms and blanks, which say nothing of an encoding."""
    return any(ord(c) > 127 and c not in LOOK_ALIKE and not look(c).isascii() or c in "¡²³´¹º»¼½¾¨¯¸ª" for c in run)


def _hits(line: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs of a line without ASCII that an improbable segment touches."""
    return [(m.start(), m.end()) for m in _HIGH.finditer(line) if any(a < m.end() and b > m.start() for a, b in spans)]


def _plain(line: str) -> str:
    """The line with look-alikes and width forms as the letters they look like: another reading of improbable pairs."""
    return unicodedata.normalize("NFC", line.translate(_LOOKS))


class Restorer:
    """Undoes wrong decodings inside improbable runs. What a run in its surroundings can become is worked out once."""

    def __init__(self, model: Model, margin: float = 6.0, depth: int = 3, keep: int = 100_000):
        self.model, self.margin, self.depth, self.keep = model, margin, depth, keep
        self.parts: dict[tuple[str, str, str], tuple[float, str, int] | None] = {}
        self.runs: dict[str, tuple[str, ...] | None] = {}
        self.lines: dict[str, tuple[str | None, bool]] = {}

    def _part(self, before: str, body: str, after: str) -> tuple[float, str, int] | None:
        """(bits saved, decoded text, characters taken after the body) of the best inverse mapping of a stretch, or None.

        A mapping that ends in a two-byte character may take one ASCII letter after the stretch.
        """
        key = (before, body, after)
        if key in self.parts:
            return self.parts[key]
        if len(self.parts) >= self.keep:
            self.parts.clear()
        best = None
        if _telling(body):
            strange = max(self.margin, 1.0 * len(_NON_ASCII.findall(body)))
            for more in (0, 1) if after[:1].strip() else (0,):
                part = body + after[:more]
                around = (before or "\n", after[more : more + 1] or "\n")
                now = None
                for wrong in _WIDE if _HAN.search(part) and not more else ():
                    try:
                        raw = part.encode(wrong)
                    except UnicodeEncodeError:
                        continue
                    best, now = self._decoded(raw, part, around, ("utf-8",), strange, more, best, now)
                for wrong, table in _WRONG.items():
                    raw = _bytes(part, table)
                    if raw is not None:
                        right = tuple(r for r in (_DOUBLE if more else _RIGHT) if r != wrong)
                        best, now = self._decoded(raw, part, around, right, strange, more, best, now)
        self.parts[key] = best
        return best

    def _decoded(self, raw: bytes, part: str, around: tuple[str, str], rights: tuple[str, ...], least: float, more: int, best, now):
        for right in rights:
            try:
                text = raw.decode(right)
            except UnicodeDecodeError:
                continue
            if text == part or "\n" in text:
                continue
            if now is None:
                now = (self.model.between(*around, part), len(_MIXED.findall(around[0] + part + around[1])))
            if len(_MIXED.findall(around[0] + text + around[1])) > now[1]:
                continue
            saved = now[0] - self.model.between(*around, text)
            if saved >= least and (best is None or saved > best[0]):
                best = (saved, text, more)
        return best, now

    def _utf8_run(self, run: str) -> tuple[str, ...] | None:
        """What a run is once each encoding of _UTF8_READ_AS is undone; None where none can be."""
        if run in self.runs:
            return self.runs[run]
        if len(self.runs) >= self.keep:
            self.runs.clear()
        made = tuple(_utf8(run, _WRONG[name]) for name in _UTF8_READ_AS)
        self.runs[run] = out = None if all(x == run for x in made) else made
        return out

    def _utf8_runs(self, line: str, bits: float) -> tuple[float, str] | None:
        """The best of UTF-8 undone run by run, as often as it can be: the runs between may be sound."""
        if all(self._utf8_run(r) is None for r in _HIGH.findall(line)):
            return None
        best = None
        for k in range(len(_UTF8_READ_AS)):
            whole = line
            for _ in range(self.depth):
                once = _HIGH.sub(lambda m, k=k: (self._utf8_run(m.group()) or (m.group(),) * (k + 1))[k], whole)
                if once == whole or "\n" in once:
                    break
                whole = once
                saved = bits - self.model.bits(whole)
                if saved >= self.margin and (best is None or saved > best[0]):
                    best = (saved, whole)
        return best

    def undo(self, line: str, depth: int | None = None) -> str | None:
        """The line as it was before the wrong decoding, or None where no inverse mapping makes it more probable.

        Inverse mappings are tried inside the improbable runs only: UTF-8 in each run by itself, other encodings from the
        first such run to the last (a text is read in one wrong encoding, and a lone short run fits many). A mapping is taken if the corpus codes the line in fewer bits by
        `margin` and by a bit a character, also against the line with look-alikes undone; it may have happened more than
        once.
        """
        depth = self.depth if depth is None else depth
        model = self.model
        hits = _hits(line, model.segments(line))
        if not hits:
            return None
        bits = model.bits(line)
        best = self._utf8_runs(line, bits)
        a, b = hits[0][0], hits[-1][1]
        found = self._part(line[a - 1 : a], line[a:b], line[b : b + 2])
        if found is not None and (best is None or found[0] > best[0]):
            best = (found[0], line[:a] + found[1] + line[b + found[2] :])
        if best is None:
            return None
        other = _plain(line)
        if other != line and model.bits(other) - model.bits(best[1]) < self.margin:
            return None
        if depth > 1 and _NON_ASCII.search(best[1]):
            again = self.undo(best[1], depth - 1)
            if again is not None:
                return again
        return best[1]

    def line(self, line: str) -> tuple[str | None, bool]:
        """(restored line or None, whether the line shows a wrong decoding that is not undone)."""
        if line in self.lines:
            return self.lines[line]
        if len(self.lines) >= self.keep:
            self.lines.clear()
        fixed = self.undo(line)
        out = self.lines[line] = (fixed, CERTAIN.search(line if fixed is None else fixed) is not None)
        return out


def _utf8(run: str, table: dict[int, int]) -> str:
    raw = _bytes(run, table)
    if raw is None:
        return run
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return run


def repair(text: str, restorer: Restorer, gains: np.ndarray | None = None, least: float = 0.75) -> tuple[bool, str, bool]:
    """(affected, text restored where possible, whether every affected line was restored)."""
    lines = text.split("\n")
    if gains is None:
        gains = restorer.model.gains(lines)
    hit, whole = False, True
    for i, line in enumerate(lines):
        if line.isascii() or gains[i] < least and CERTAIN.search(line) is None:
            continue
        fixed, left = restorer.line(line)
        if fixed is not None:
            hit = True
            lines[i] = fixed
        if left:
            hit, whole = True, False
    return hit, "\n".join(lines), whole


def _arrays(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The table of pairs on the driver: at most SYMBOLS squared small rows, whatever the corpus."""
    table = counts.toArrow()
    return table.column("pair").to_numpy(), table.column("n").to_numpy()


def garbled_fields(df: DataFrame, id_col: str, text_cols: list[str], restored: bool = False) -> DataFrame:
    """(id, field): the text fields in which at least one line shows characters of a wrong decoding.

    With `restored` also (text, whole): the field with every line restored that can be, and whether all could. Pair
    counts are taken over all rows of all the fields (one small exchange of counts summed per partition); the table of
    pairs has a fixed bound and goes to every task; the second pass has no exchange. Null and empty fields are no
    cases; equal texts of a batch are repaired once.
    """
    spark = df.sparkSession
    pair, n = _arrays(pair_counts(df, text_cols))
    shared = spark.sparkContext.broadcast((pair, n))
    kind = df.schema[id_col].dataType.simpleString()
    chosen = df.select(F.col(id_col).alias("id"), *(F.col(c).alias(f"t{k}") for k, c in enumerate(text_cols)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        restorer = Restorer(model)
        for batch in batches:
            row, field, text, whole = [], [], [], []
            for k, name in enumerate(text_cols):
                coded = batch.column(1 + k).dictionary_encode()
                texts = coded.dictionary.to_pylist()
                done: list[tuple[bool, str, bool]] = []
                for at in range(0, len(texts), 2000):
                    part = texts[at : at + 2000]
                    lines = [t.split("\n") for t in part]
                    gains = model.gains([x for each in lines for x in each])
                    i = 0
                    for t, each in zip(part, lines, strict=True):
                        done.append(repair(t, restorer, gains[i : i + len(each)]))
                        i += len(each)
                for i, c in enumerate(coded.indices.to_pylist()):
                    if c is not None and done[c][0]:
                        row.append(i)
                        field.append(name)
                        text.append(done[c][1])
                        whole.append(done[c][2])
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(field, pa.string())]
            if restored:
                columns += [pa.array(text, pa.string()), pa.array(whole, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "field", "text", "whole"][: len(columns)])

    return chosen.mapInArrow(run, f"id {kind}, field string" + (", text string, whole boolean" if restored else ""))
