"""Problem 6: the main body of a page, by a linear-chain conditional random field over DOM leaf blocks and lines."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.urls import site_key
from quire.llm.chars import fold, look
from quire.llm.crf import Chain
from quire.llm.html_blocks import Block, Page, parse
from quire.llm.p3_markup import languages

MAIN, FURNITURE = 0, 1

_MARKS = "".join(c for c in map(chr, range(0x300, 0x10000)) if unicodedata.category(c) in ("Mn", "Mc"))
_WORD = re.compile(rf"[^\W\d_]+(?:[{_MARKS}]+[^\W\d_]*)*|\d+|[^\w\s]")  # marks stay with their letters
_CJK = re.compile(r"[぀-ヿ㐀-鿿฀-๿]")
_SAYS = re.compile(r"[^\W_]")
_SPACE = re.compile(r"\s+")
_SQUASH = re.compile(r"[\W_]+")
_ENDS = re.compile(r"[.!?…。！？।»”\"'’」』:：]\s*\Z")


# Tables, formulas, code: matter of a chapter that its other fetch may have lost.
_MATTER = re.compile(r"\s*\|.*\|\s*\Z|\s*[^\W\d_]\w*\s*=\s*[^\s=][^.!?。！？]*\Z|\s*(?:```|~~~)|\s*\\\w|.*[;{}]\s*\Z|\s*(?:if|while|for|return|def)\b.*[:;{)]\s*\Z")


def _is_matter(text: str) -> bool:
    return len(text) < 90 and _MATTER.match(text) is not None or bool(languages(text))


def _bin(n: int) -> str:
    for k, top in enumerate((4, 8, 14, 22, 32, 48, 70, 110, 180, 300)):
        if n <= top:
            return str(k)
    return "x"


def text_features(text: str) -> list[str]:
    """Features of a line's text in its consistent form: words, signs, shape. Each word and pair of the whole line counts once."""
    plain = fold(form := look(text)).strip()
    tokens: list[str] = []
    for w in _WORD.findall(plain):
        if w[0].isdigit():
            tokens.append("0")
        elif _CJK.match(w):
            tokens += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
        else:
            tokens.append(w)
    size = len(plain) + 2 * len(_CJK.findall(plain))
    out = ["bias", "len:" + _bin(size), "end:" + (plain[-1] if plain and not plain[-1].isalnum() else "a" if plain and plain[-1].isalpha() else "0")]
    out += ["w:" + t for t in dict.fromkeys(tokens)]
    out += ["b:" + a + " " + b for a, b in dict.fromkeys(zip(tokens, tokens[1:], strict=False))]
    out += ["f:" + t for t in tokens[:1]] + ["l:" + t for t in tokens[-2:]]
    letters = [c for c in form if c.isalpha()]
    if letters:
        upper = sum(c.isupper() for c in letters) / len(letters)
        out.append("upper:" + str(int(upper * 4)))
        out.append("first:" + ("U" if letters[0].isupper() else "L"))
    signs = Counter(c for c in plain if not c.isalnum() and not c.isspace())
    for c in "|·»›/,–-.":
        if signs[c] >= 2:
            out.append(f"many:{c}:{min(4, signs[c])}")
    if re.match(r"\d+[.)] ", plain):
        out.append("numbered")
    if re.search(r"\w\.(?:example|invalid|test|com|net|org)\b", plain):
        out.append("domain")
    if re.match(r".{1,24} \(\d+\)\s?[:：]", plain):
        out.append("comment")
    if not _ENDS.search(plain):
        out.append("open:" + _bin(size))
    if len(text) < 90 and _MATTER.match(text):
        out.append("matter")
    return out


def _shared_names(features: list[str]) -> list[str]:
    """The same features, each name held once in memory: a training sample repeats them many times."""
    return [sys.intern(f) for f in features]


def _site_feature(text: str, stem: str) -> list[str]:
    return ["site"] if stem and stem in _SQUASH.sub("", text.lower()) else []


def _stem(site: str | None) -> str:
    return _SQUASH.sub("", (site or "").split(".")[0])


def _around(shapes: list[str]) -> list[list[str]]:
    """Features from the neighbours' shapes and from the place in the sequence."""
    n = len(shapes)
    out = []
    for i, s in enumerate(shapes):
        before, after = (shapes[i - 1] if i else "^"), (shapes[i + 1] if i + 1 < n else "$")
        out.append([f"p:{before}", f"n:{after}", f"pn:{before}{s}{after}", f"at:{min(i, 4)}", f"to:{min(n - 1 - i, 5)}"])
    return out


def _shape(text: str) -> str:
    return _bin(len(text) + 2 * len(_CJK.findall(text))) + ("." if _ENDS.search(text) else "_")


def content_items(content: str) -> list[tuple[int, str]]:
    """(line_no, line) of the lines that hold anything."""
    return [(k, line) for k, line in enumerate(content.split("\n"), 1) if line.strip()]


def block_features(page: Page, site: str | None) -> list[list[str]]:
    """Features of each leaf block beside its text: ancestors, links, and how much text its container holds."""
    stem = _stem(site)
    blocks = page.blocks
    mass: Counter = Counter()
    count: Counter = Counter()
    heads = set()
    for b in blocks:
        for k in range(1, len(b.path) + 1):
            prefix = b.path[:k]
            mass[prefix] += len(b.text) - b.links
            count[prefix] += 1
        if b.path and b.path[-1][0] == "h1":
            heads.add(b.path[:-1])
    total = max(1, sum(len(b.text) - b.links for b in blocks))
    out = []
    around = _around([_shape(b.text) + (b.path[-1][0] if b.path else "") for b in blocks])
    for b, near in zip(blocks, around, strict=True):
        path = [p for p in b.path if p[0] not in ("html", "body")]
        tags = [t for t, _ in path] or ["body"]
        box = b.path[:-1] if b.path and (b.path[-1][0] not in ("div", "td", "section", "article", "main") or len(path) > 1) else b.path
        f = [f"tag:{tags[-1]}", "path:" + ">".join(tags[-3:]), f"link:{int(4 * b.links / max(1, len(b.text)))}", f"bold:{int(3 * b.emphasis / max(1, len(b.text)))}"]
        for t, c in path[-3:]:
            if c:
                f += [f"cls:{x}" for x in c.lower().split()[:3]]
                f.append(f"own:{stem}:{c}")
            else:
                f.append(f"plain:{t}")
        if path and path[-1][1]:
            f.append("leafcls")
        share = mass[box] / total
        f += [f"share:{int(5 * share)}", f"share:{int(5 * share)}:{tags[-1]}", f"kids:{_bin(count[box])}", f"mean:{_bin(mass[box] // max(1, count[box]))}"]
        inside = any(b.path[: len(h)] == h for h in heads if len(h) > 2 or len(heads) == 1)
        f.append(f"h1box:{inside}")
        if b.code:
            f.append("code")
        f += _site_feature(b.text, stem)
        if not stem:
            f.append("book")
        out.append(f + near)
    return out


_GARBLED = re.compile(r"[\u0080-\u00a7\u00a9-\u00ff\u0152-\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122]")
_HALF = re.compile(r"[РСГЃ][\u0080-\u00bf\u0402-\u040f\u0452-\u045f\u0490\u0491\u2013-\u203a\u20ac\u2116\u2122°±»µ]|√.|[а-я][А-Я]{3}")


def _garbled(text: str) -> bool:
    """Whether most of a line is characters of a wrong decoding, so that its page cannot bear it out."""
    strange = [c for c in text if ord(c) > 127]
    if len(strange) < 6 or len(strange) < 0.4 * len(text.replace(" ", "")):
        return False
    return len(_GARBLED.findall(text)) > 0.8 * len(strange) or len(_HALF.findall(text)) > 0.12 * len(strange)


class Shown:
    """What a page shows in its body: tells of a content line whether the page bears it out."""

    def __init__(self, html: str | None):
        self.blocks = [] if html is None else [b for b in parse(html).blocks if not any(t in ("nav", "footer") for t, _ in b.path)]
        self.raw = {b.text for b in self.blocks}

    def tell(self, lines: list[str]) -> list[str]:
        """For each line "yes", "near" (inline markup, garbled letters) or "no"; "none" where the page shows other text.

        Lines that stand in the page as they are need no normalising; only what is left on both sides is compared by form.
        """
        out = ["yes" if t in self.raw or _SPACE.sub(" ", t).strip() in self.raw else "" for t in lines]
        if "" in out and self.blocks:
            told = {t for t, k in zip(lines, out, strict=True) if k}
            rest = [(b, n) for b in self.blocks if b.text not in told and (n := _norm(b.text))]
            known = {n for _, n in rest}
            pieces = [n for n in known if len(n) > 30]
            heads = [n for b, n in rest if b.path and b.path[-1][0] in ("h1", "h2", "h3") and len(n) > 5]
            for i, t in enumerate(lines):
                if out[i]:
                    continue
                n = _norm(t)
                if not n or n in known or len(n) > 30 and any(n in k or k in n for k in pieces):
                    out[i] = "yes"
                elif len(n) > 5 and any(h.startswith(n) or n.startswith(h) for h in heads):
                    out[i] = "yes"
                elif len(n) > 30 and pieces and _near(n, pieces) or len(n) > 10 and heads and _near(n, heads) or _garbled(t):
                    out[i] = "near"
                else:
                    out[i] = "no"
        hits = sum(a == "yes" for a, t in zip(out, lines, strict=True) if _SAYS.search(t))
        return out if len(self.raw) >= 3 and hits >= 2 and hits >= 0.3 * len(lines) else ["none"] * len(lines)


def content_features(lines: list[str], site: str | None, told: list[str]) -> list[list[str]]:
    """Features of content lines beside their text: what the page says of them and of their neighbours, and shapes."""
    stem = _stem(site)
    ends = ["^", *told, "$"]
    out = []
    for i, (t, near) in enumerate(zip(lines, _around([_shape(t) for t in lines]), strict=True)):
        f = [f"dom:{told[i]}", f"doms:{ends[i]}:{told[i]}:{ends[i + 2]}"]
        out.append(f if told[i] == "yes" else f + near + _site_feature(t, stem))
    return out


def _norm(text: str) -> str:
    return _SQUASH.sub("", fold(look(text)))


def label_content(content: str, shown: Shown) -> tuple[list[str], list[int], list[str]] | None:
    """Lines of a content, their labels, and what the page tells of them: its paragraphs are the body, others furniture.

    Markup and dividers are body whether or not the page shows them. None where the page shows other text.
    """
    lines = [t for _, t in content_items(content)]
    told = shown.tell(lines)
    if not lines or told[0] == "none":
        return None
    labels = [MAIN if k in ("yes", "near") or not _SAYS.search(t) or _is_matter(t) else FURNITURE for t, k in zip(lines, told, strict=True)]
    return lines, labels, told


def _near(n: str, pieces: list[str]) -> bool:
    """Whether a line shares most of its stretches of eight characters with the page (inline markup, garbled letters)."""
    grams = {n[i : i + 6] for i in range(0, len(n) - 5, 3)}
    return any(sum(g in p for g in grams) >= 0.4 * len(grams) for p in pieces)


def label_page(page: Page, partner: str) -> list[int] | None:
    """Labels of a page's blocks from another fetch of the same chapter whose paragraphs are known.

    The container that holds most of the shared paragraphs is the body; in it unmatched lists, tables, code, headings and
    markup are body too, other unmatched lines furniture.
    """
    known = {_norm(b.text) for b in parse(partner).blocks if not any(t in ("nav", "footer") for t, _ in b.path)}
    known.discard("")
    matched = [len(_norm(b.text)) > 0 and _norm(b.text) in known for b in page.blocks]
    boxes: Counter = Counter()
    for b, ok in zip(page.blocks, matched, strict=True):
        if ok and len(b.text) > 30:
            for k in range(3, len(b.path) + 1):
                boxes[b.path[:k]] += len(b.text)
    if not boxes:
        return None
    most = max(boxes.values())
    box = max((p for p, n in boxes.items() if n >= 0.9 * most), key=len)
    while box and box[-1][0] in ("p", "li", "h1", "h2", "h3", "blockquote"):
        box = box[:-1]
    labels = []
    for b, ok in zip(page.blocks, matched, strict=True):
        inside = b.path[: len(box)] == box
        rest = b.path[len(box) :]
        if not inside:  # a heading that the other fetch bears out may stand above the body
            labels.append(MAIN if ok and b.path and b.path[-1][0] in ("h1", "h2") else FURNITURE)
        elif ok or b.code or not _SAYS.search(b.text) or _is_matter(b.text):
            labels.append(MAIN)
        elif any(t in ("li", "td", "th", "pre", "blockquote", "h1", "h2", "h3", "ol", "ul", "table") for t, _ in rest) and not any(c for t, c in rest if t in ("div", "p", "span")):
            labels.append(MAIN)
        else:
            labels.append(FURNITURE)
    return labels if sum(matched) >= 2 else None


def fit_content(rows: list[tuple[str, str, str]]) -> Chain:
    """From (site, content, html). Two rows of five are taught without their page, so that the text alone decides too."""
    sequences, labels = [], []
    for i, (site, content, html) in enumerate(rows):
        if (made := label_content(content, Shown(html))) is not None:
            lines, y, told = made
            if i % 5 < 2:
                told = ["none"] * len(lines)
            beside = content_features(lines, site, told)
            sequences.append([f if k == "yes" else _shared_names(text_features(t)) + f for t, f, k in zip(lines, beside, told, strict=True)])
            labels.append(y)
    return Chain.fit(sequences, labels)


def fit_pages(rows: list[tuple[str, str, str | None]]) -> Chain:
    """From (site, page, partner page); a page without partner is a book chapter and all body."""
    sequences, labels = [], []
    for site, html, partner in rows:
        page = parse(html)
        y = label_page(page, partner) if partner is not None else [MAIN] * len(page.blocks)
        if y is not None and page.blocks:
            sequences.append([a + b for a, b in zip((_shared_names(text_features(b.text)) for b in page.blocks), block_features(page, site), strict=True)])
            labels.append(y)
    return Chain.fit(sequences, labels)


class Labeller:
    """Labels sequences with a chain; the text part of an item's score is kept, as furniture repeats."""

    def __init__(self, chain: Chain, keep: int = 200_000):
        self.chain, self.keep, self.known = chain, keep, {}

    def text_score(self, text: str) -> float:
        s = self.known.get(text)
        if s is None:
            if len(self.known) >= self.keep:
                self.known.clear()
            s = self.known[text] = self.chain.score(text_features(text))
        return s

    def content(self, content: str, site: str | None, html: str | None) -> list[tuple[int, int]]:
        items = content_items(content)
        lines = [t for _, t in items]
        told = Shown(html).tell(lines)
        beside = content_features(lines, site, told)
        scores = [self.chain.score(f) + (0.0 if k == "yes" else self.text_score(t)) for t, f, k in zip(lines, beside, told, strict=True)]
        return [(no, y) for (no, _), y in zip(items, self.chain.viterbi(scores), strict=True)]

    def page(self, page: Page, site: str | None) -> list[tuple[Block, int]]:
        scores = [self.text_score(b.text) + self.chain.score(f) for b, f in zip(page.blocks, block_features(page, site), strict=True)]
        return list(zip(page.blocks, self.chain.viterbi(scores), strict=True))


def _sampled(df: DataFrame, id_col: str, sample: int) -> DataFrame:
    """About `sample` rows chosen by a hash of their id: a filter that runs where the rows are, so nothing is sorted or
    gathered to choose them, and the same rows come each time."""
    share = max(1, -(-df.count() // max(1, sample)))  # the count comes from the files' metadata
    return df.where(F.pmod(F.xxhash64(id_col), F.lit(share)) == 0)


_EDGE = "\x00"  # names the weights of neighbouring labels among those of features


def _fitted(rows: DataFrame, fit) -> Chain:
    """`fit` run in one task on the rows of a bounded sample, ordered by their columns; the driver sees only the weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        chain = fit([row[1:] for row in sorted(found, key=lambda row: tuple((x is not None, x) for x in row))])
        edges = [*chain.trans.reshape(-1).tolist(), *chain.start.tolist(), *chain.end.tolist()]
        names = [*chain.weights, *(_EDGE + str(k) for k in range(len(edges)))]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([*chain.weights.values(), *edges], pa.float64())], names=["feature", "weight"])

    table = rows.repartition(1).mapInArrow(run, "feature string, weight double").toArrow()
    weights = dict(zip(table.column("feature").to_pylist(), table.column("weight").to_pylist(), strict=True))
    edges = np.array([weights.pop(_EDGE + str(k), 0.0) for k in range(8)])
    return Chain(weights, edges[:4].reshape(2, 2), edges[4:6], edges[6:])


def train_content(contexts: DataFrame, sample: int = 2500) -> Chain:
    """Fit on about `sample` rows, those with content and html."""
    some = _sampled(contexts, "ctx_id", sample).where("content is not null and html is not null")
    return _fitted(some.select("ctx_id", site_key(F.col("url")).alias("site"), "content", "html"), fit_content)


def train_pages(raw: DataFrame, contexts: DataFrame, sample: int = 3000, books: int = 4) -> Chain:
    """Fit on about `sample` pages: web pages that a fetch of the same url bears out, and one in `books` book chapters."""
    some = _sampled(raw, "raw_id", sample).where("html is not null")
    web = some.where("source_url is not null").select("raw_id", "source_url", "html")
    other = contexts.where("html is not null and content is not null").select(F.col("url").alias("source_url"), F.col("html").alias("partner"))
    # the sample's addresses are a bounded list, so they go to the rows instead of the rows to them
    other = other.join(F.broadcast(web.select("source_url").distinct()), "source_url", "left_semi")
    pairs = web.join(other, "source_url").groupBy("raw_id").agg(F.first("source_url").alias("u"), F.first("html").alias("html"), F.min("partner").alias("partner"))
    paired = pairs.select("raw_id", site_key(F.col("u")).alias("site"), "html", "partner")
    chapters = some.where((F.col("source_url").isNull()) & (F.pmod(F.xxhash64("raw_id", F.lit(1)), F.lit(books)) == 0))
    alone = chapters.select("raw_id", F.lit(None).cast("string").alias("site"), "html", F.lit(None).cast("string").alias("partner"))
    return _fitted(paired.unionByName(alone), fit_pages)


def train(contexts: DataFrame, raw: DataFrame) -> tuple[Chain, Chain]:
    """Both chains, fitted side by side."""
    with ThreadPoolExecutor(2) as pool:
        one, two = pool.submit(train_content, contexts), pool.submit(train_pages, raw, contexts)
        return one.result(), two.result()


def _shared(chain: Chain):
    return (chain.weights, chain.trans, chain.start, chain.end)


def furniture_lines(contexts: DataFrame, raw: DataFrame, content_chain: Chain, page_chain: Chain) -> DataFrame:
    """(src, rec_id, line_no): lines that show text outside the main body, in content and in html.

    Lines without letter or digit are dividers and never furniture. Null texts give no rows; a repeated row gives its
    lines again. Two Arrow passes without an exchange; both models were fitted on bounded samples.
    """
    spark = contexts.sparkSession
    a, b = spark.sparkContext.broadcast(_shared(content_chain)), spark.sparkContext.broadcast(_shared(page_chain))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(Chain(*a.value))
        for batch in batches:
            rec, no = [], []
            for i, site, text, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = text.split("\n")
                found = [k for k, y in labeller.content(text, site, html) if y == FURNITURE and _SAYS.search(lines[k - 1])]
                rec += [i] * len(found)
                no += found
            yield _out("pipeline_contexts", rec, no)

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(Chain(*b.value))
        for batch in batches:
            rec, no = [], []
            for i, site, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = sorted({x.line for x, y in labeller.page(parse(html), site) if y == FURNITURE and _SAYS.search(x.text)})
                rec += [i] * len(found)
                no += found
            yield _out("raw_documents", rec, no)

    schema = "src string, rec_id long, line_no int"
    one = contexts.select(F.col("ctx_id").cast("long").alias("rec_id"), site_key(F.col("url")).alias("site"), "content", "html").where("content is not null")
    two = raw.select(F.col("raw_id").cast("long").alias("rec_id"), site_key(F.col("source_url")).alias("site"), "html").where("html is not null")
    return one.mapInArrow(contents, schema).unionByName(two.mapInArrow(pages, schema))


def _out(src: str, rec: list[int], no: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([src] * len(rec), pa.string()), pa.array(rec, pa.int64()), pa.array(no, pa.int32())], names=["src", "rec_id", "line_no"]
    )


def main_bodies(contexts: DataFrame, raw: DataFrame, content_chain: Chain, page_chain: Chain) -> DataFrame:
    """(src, rec_id, main_body): only the main body of each record, one line a block. Null texts give null."""
    spark = contexts.sparkSession
    a, b = spark.sparkContext.broadcast(_shared(content_chain)), spark.sparkContext.broadcast(_shared(page_chain))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(Chain(*a.value))
        for batch in batches:
            out = []
            for _, site, text, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text is not None:
                    lines = text.split("\n")
                    drop = {k for k, y in labeller.content(text, site, html) if y == FURNITURE and _SAYS.search(lines[k - 1])}
                    text = "\n".join(t for k, t in enumerate(lines, 1) if k not in drop)
                out.append(text)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(["pipeline_contexts"] * n), batch.column(0), pa.array(out, pa.string())], names=["src", "rec_id", "main_body"])

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(Chain(*b.value))
        for batch in batches:
            out = []
            for _, site, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append(None if html is None else "\n".join(x.text for x, y in labeller.page(parse(html), site) if y == MAIN))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(["raw_documents"] * n), batch.column(0), pa.array(out, pa.string())], names=["src", "rec_id", "main_body"])

    schema = "src string, rec_id long, main_body string"
    one = contexts.select(F.col("ctx_id").cast("long").alias("rec_id"), site_key(F.col("url")).alias("site"), "content", "html")
    two = raw.select(F.col("raw_id").cast("long").alias("rec_id"), site_key(F.col("source_url")).alias("site"), "html")
    return one.mapInArrow(contents, schema).unionByName(two.mapInArrow(pages, schema))
