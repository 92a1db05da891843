"""Problem 4: template residue and error-page text, by positive-unlabelled naive Bayes with expectation-maximization."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.html_blocks import Page, parse

CLASSES = ("chapter", "error_page", "script_required", "filler", "template")
CHAPTER, ERROR, SCRIPT, FILLER, TEMPLATE = range(5)

# Unfilled placeholders of common template languages, and the words people leave for themselves.
PLACEHOLDER = re.compile(
    r"\{\{\{?\s*[#/^>&]?\s*[A-Za-z_][\w.]*(?:\s+[\w.]+)*(?:\s*\|\s*(?:upper|lower|title|capitalize|safe|escape|e|trim|default|date|truncate|raw)\b(?:\([^)]*\)|:[^}]*)?)*\s*\}?\}\}"
    r"|\$\{\s*[A-Za-z_][\w.]*\s*\}|#\{\s*[A-Za-z_][\w.]*\s*\}|<%[=-]?\s*[\w.@ ()]+-?%>|\[%-?\s*[\w.]+(?:\s[\w.]+)*\s*-?%\]|\{%-?\s*[^%]{1,60}-?%\}"
    r"|<\?(?:php|=)[^?]*\?>|\[\[[+*~$%!][\w.]+\]\]|@@\w+@@|##[A-Z_]+##|%[A-Z][A-Z0-9]*_[A-Z0-9_]*%|%%[A-Z_]+%%|__[A-Z][A-Z0-9_]*[A-Z0-9]__"
    r"|\{[a-z]+(?:_[a-z]+)*\}|\{\d\}(?!\})|(?<!\w)%s\b|(?<!\w)%\(\w+\)s"
    r"|\[(?:INSERT|YOUR|ENTER|ADD|REPLACE|PLACEHOLDER)\b[A-Z ]*\]|\[(?:insert|your|enter|replace) [a-z ]+\]|\b(?:TODO|FIXME|TBD|XXX):"
)
_SIGNS = re.compile(r"[{}\[\]<%#@$]|__|TODO|FIXME|TBD|XXX")
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿฀-๿]")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s*")


def words(text: str) -> list[str]:
    """Features of a passage: folded words, numbers as one, runs of signs, pairs of characters of scripts without blanks."""
    out = []
    for w in _WORD.findall(text.lower()):
        if w[0].isdigit():
            out.append("0")
        elif _CJK.match(w):
            out += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
        else:
            out.append(w)
    out += ["\u0001" + _shape(m.group()) for m in PLACEHOLDER.finditer(text)]
    if len(out) < 12:
        out.append("\u0002short")
    return out


def _shape(token: str) -> str:
    return re.sub(r"\w+", "w", token)


def _furniture(path: tuple[tuple[str, str], ...]) -> bool:
    return any(tag in ("nav", "footer", "header", "aside") for tag, _ in path)


def passages(page: Page) -> tuple[list[str], list[str]]:
    """(headings, passages) of the visible body without menus and footers."""
    heads, body = [], []
    for b in page.blocks:
        if not _furniture(b.path):
            (heads if b.path and b.path[-1][0] in ("h1", "h2", "h3") else body).append(b.text)
    return heads, body


def visible(page: Page) -> list[str]:
    """The title and all text the body shows, menus and footers too: a placeholder counts wherever it stands."""
    return [page.title, *(b.text for b in page.blocks)]


def trusted(page: Page, status: int | None, brief: int = 130, pieces: int = 4) -> tuple[int, list[str]]:
    """A reason and its passages where the record alone proves it; CHAPTER stands for unlabelled.

    An error status proves an error only where the page shows at most `pieces` passages and fewer than `brief` characters:
    these bounds pick what teaches, not what is found.
    """
    heads, body = passages(page)
    marked = [t for t in visible(page) if PLACEHOLDER.search(t)]
    if marked:
        return TEMPLATE, marked
    if not body and not heads and page.noscript and page.scripts:
        return SCRIPT, [page.noscript]
    shown = [*heads, *body]
    if status is not None and status >= 400 and shown and sum(map(_weight, shown)) < brief and len(shown) <= pieces:
        return ERROR, shown
    sentences = [re.sub(r"\d+", "0", s) for t in body for s in _SENTENCE.split(t) if len(s) > 11]
    if len(sentences) >= 3:
        most = Counter(sentences).most_common(1)[0][1]
        if most >= 3 and most >= 0.6 * len(sentences):
            return FILLER, body
    bag = [w for t in body for w in words(t) if w.isalpha()]
    if ("lorem" in bag or "ipsum" in bag) and bag.count("ipsum") + bag.count("lorem") >= 2 and len(set(bag)) < 0.8 * len(bag):
        return FILLER, body
    return CHAPTER, body


def _weight(text: str) -> int:
    """Length of a text as it reads: a character of a script without blanks counts three."""
    return len(text) + 2 * len(_CJK.findall(text))


class Bayes:
    """Multinomial naive Bayes over passages; classes of trusted passages stay, others are learned by EM."""

    def __init__(self, weights: dict[str, np.ndarray], prior: np.ndarray, unseen: np.ndarray):
        self.weights, self.prior, self.unseen = weights, prior, unseen

    @staticmethod
    def fit(labels: list[int], texts: list[str], rounds: int = 6, alpha: float = 0.05) -> Bayes:
        vocabulary: dict[str, int] = {}
        rows, columns, counts = [], [], []
        for i, t in enumerate(texts):
            for w, n in Counter(words(t)).items():
                rows.append(i)
                columns.append(vocabulary.setdefault(w, len(vocabulary)))
                counts.append(n)
        r, c, n = np.array(rows, dtype=np.int64), np.array(columns, dtype=np.int64), np.minimum(np.array(counts, dtype=float), 3.0)
        y, k = np.array(labels), len(CLASSES)
        known = y != CHAPTER
        post = np.zeros((len(y), k))
        post[np.arange(len(y)), y] = 1.0
        size = len(vocabulary)
        for _ in range(rounds):
            prior = np.log((post.sum(axis=0) + 1) / (len(y) + k))
            mass = np.zeros((size, k))
            for j in range(k):
                mass[:, j] = np.bincount(c, weights=n * post[r, j], minlength=size)
            total = mass.sum(axis=0)
            logs = np.log((mass + alpha) / (total + alpha * (size + 1)))
            score = np.tile(prior, (len(y), 1))
            for j in range(k):
                score[:, j] += np.bincount(r, weights=n * logs[c, j], minlength=len(y))
            score -= score.max(axis=1, keepdims=True)
            fresh = np.exp(score)
            fresh /= fresh.sum(axis=1, keepdims=True)
            post[~known] = fresh[~known]
        unseen = np.log(alpha / (total + alpha * (size + 1)))
        # a word never seen says nothing for any class
        return Bayes({w: logs[i] for w, i in vocabulary.items()}, prior, np.full(k, unseen.mean()))

    def score(self, text: str) -> np.ndarray:
        """Log posterior of a passage, up to a constant."""
        out = self.prior.copy()
        for w, n in Counter(words(text)).items():
            out += min(n, 3) * self.weights.get(w, self.unseen)
        return out - out.max()


def decide(page: Page, model: Bayes) -> str | None:
    """The reason to exclude a record, or None. Passages are scored; a chapter passage outweighs all but a placeholder."""
    heads, body = passages(page)
    if _SIGNS.search(text := "\n".join(visible(page))) and PLACEHOLDER.search(text):
        for t in visible(page):
            if PLACEHOLDER.search(t) and model.score(t).argmax() == TEMPLATE:
                return CLASSES[TEMPLATE]
    shown = body or heads
    if not shown:
        if page.noscript and model.score(page.noscript).argmax() in (SCRIPT, ERROR):
            return CLASSES[SCRIPT]
        return None
    total = np.zeros(len(CLASSES))
    for t in sorted(shown, key=len, reverse=True):  # a chapter shows in its longest passage
        score = model.score(t)
        if score.argmax() == CHAPTER:
            return None
        total += score
    return CLASSES[1 + int(total[1:TEMPLATE].argmax())]


# Shapes that make a row worth a look when the training sample is drawn; they decide nothing else.
_TELLING = r"(?i)lorem|ipsum|\{\{|\$\{|#\{|&lt;%|\[%|@@|__[A-Z]|%s|TODO:|\[\[\+"


def train(df: DataFrame, id_col: str, html_col: str, status_col: str, sample: int = 12000, short: int = 900, rare: float = 0.05) -> Bayes:
    """Fit on the passages of at most `sample` records: half that look telling at first sight (a short page or a telling
    shape), half of all others; of each half those with the least hash of their id, so every run takes the same.

    One scan: the number of rows, known from the files, gives how small a hash must be for enough rows to be left (the
    telling ones are taken to be at least `rare` of all, else fewer train); what is parsed are those rows only, and the
    choice among them is a ranking limited within each partition. `sample` bounds what the driver holds.
    """
    half = max(1, sample // 2)
    rows = df.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"), F.col(status_col).alias("status"))
    n = max(1, rows.count())
    spread = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / F.lit(1 << 40)
    rows = rows.where("html is not null").withColumn("at", spread).where(F.col("at") < half / (rare * n))
    rows = rows.withColumn("telling", (F.length("html") < short) | F.col("html").rlike(_TELLING))
    rows = rows.where(F.col("telling") | (F.col("at") < 1.25 * half / n)).select("telling", "at", "html", "status")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [trusted(parse(html), status) for html, status in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            columns = [batch.column(0), batch.column(1), pa.array([k for k, _ in made], pa.int32()), pa.array([t for _, t in made], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["telling", "at", "label", "texts"])

    seen = rows.mapInArrow(run, "telling boolean, at double, label int, texts array<string>")
    rank = F.row_number().over(Window.partitionBy("telling").orderBy("at"))
    table = seen.withColumn("rank", rank).where(F.col("rank") <= half).select("label", F.explode("texts").alias("text")).toArrow()
    return Bayes.fit(*settled(table.column("label").to_pylist(), table.column("text").to_pylist()))


def settled(labels: list[int], texts: list[str]) -> tuple[list[int], list[str]]:
    """Training passages in a fixed order; a text that trusted records show to readers without scripts keeps that label."""
    scripts = {t for k, t in zip(labels, texts, strict=True) if k == SCRIPT}
    order = sorted((SCRIPT if t in scripts else k, t) for k, t in zip(labels, texts, strict=True))
    return [k for k, _ in order], [t for _, t in order]


def residue_records(df: DataFrame, id_col: str, html_col: str, status_col: str, sample: int = 12000) -> DataFrame:
    """(id, reason): records whose html shows no chapter, or an unfilled placeholder.

    Null html gives no row, empty html none; repeated rows are decided each. One Arrow pass over all records with the
    model fitted on a bounded sample; no exchange beyond the sample's.
    """
    model = train(df, id_col, html_col, status_col, sample)
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.prior, model.unseen))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bayes = Bayes(*shared.value)
        for batch in batches:
            row, reason = [], []
            for i, html in enumerate(batch.column(1).to_pylist()):
                if (r := decide(parse(html), bayes)) is not None:
                    row.append(i)
                    reason.append(r)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(reason, pa.string())], names=["id", "reason"])

    chosen = df.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).where("html is not null")
    return chosen.mapInArrow(run, f"id {kind}, reason string")
