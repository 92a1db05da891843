"""Safe names: slugs and file names of chapters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.functions.text import strip, strip_site_suffix

# Fixed values of the task: signs replaced in file names.
SIGNS = str.maketrans(
    {
        "–": "-", "—": "-", "…": "...", "‘": "'", "’": "'", "“": '"', "”": '"', "«": '"', "»": '"', "×": "x", "÷": "-", "©": "", "®": "",
        "™": "", "→": "-", "←": "-", "↑": "", "↓": "", "★": "", "☆": "", "♥": "", "♦": "", "♠": "", "♣": "", "•": "-", "·": "-", "。": ".",
        "，": ",",
    }
)
_RESERVED = re.compile(r"(?:CON|PRN|AUX|NUL|COM[0-9]|LPT[0-9])(?:\.|\Z)", re.I)


def slug(text: str | None, most: int = 80) -> str:
    """A name safe on every file system; 'untitled' where nothing is left."""
    s = unicodedata.normalize("NFKC", text or "").translate(SIGNS)
    s = re.sub(r'[<>:"/\\|?*\x00-\x1f]', "", s)
    s = re.sub(r"\.{2,}", ".", re.sub(r"[\s_]+", "_", s)).strip(" \t._-")
    if len(s) > most:
        s = s[:most].strip(" \t._-")
    if not s:
        return "untitled"
    return s + "_file" if _RESERVED.match(s) and s.count(".") <= 1 else s


def _slugs(most: int):
    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: slug(x, most))

    return run


slug80, slug120 = _slugs(80), _slugs(120)


def is_garbage(sub: Column) -> Column:
    """Whether a subtitle is none: a descriptor, a credit, a format, or long without any punctuation."""
    return (
        (F.length(sub) < 2)
        | sub.rlike(r"(?i)^a\s+\S.{2,70}\s+fanfic(?:tion)?\s*$|^(?:translated|edited)\s+by\b|^(?:official\s+)?(?:epub|pdf|translation)\b")
        | ((F.length(sub) > 60) & ~sub.rlike(r"[.!?,;:'\"()]"))
    )


def chapter_file(number: Column, title: Column, keyword: Column | None = None, prefix: Column | None = None) -> Column:
    """NNNN_Subtitle.md, NNNN_<keyword>n.md where there is no subtitle, NNNN_Title.md where no keyword is found."""
    keyword = F.lit("Chapter") if keyword is None else F.coalesce(strip(keyword), F.lit("Chapter"))
    t = F.substring(strip(F.coalesce(title, F.lit(""))), 1, 200)
    if prefix is not None:
        p = F.coalesce(strip(prefix), F.lit(""))
        t = F.when((p != "") & F.startswith(F.lower(t), F.lower(p)), F.regexp_replace(F.substr(t, F.length(p) + 1), r"^[ ,;:\-–—]+", "")).otherwise(t)
    t = strip(F.regexp_replace(t, r"\s*\|.*$", ""))
    pattern = F.concat(F.lit(r"(?i)\Q"), keyword, F.lit(r"\E\s*(\d+)\s*[-–—:.]?\s*(.*)"))
    n, sub = (F.call_function("regexp_extract", t, pattern, F.lit(k)) for k in (1, 2))
    sub = strip_site_suffix(strip(F.regexp_replace(F.regexp_replace(sub, r"^[ ,\-–—:\[\]().]+|[ ,\-–—:\[\]().]+$", ""), r"\s*\|.*$", "")))
    stem = F.when(n == "", slug80(t)).when(is_garbage(sub), F.concat(keyword, n)).otherwise(slug80(sub))
    return F.concat(slug120(F.concat(F.format_string("%04d", number.cast("int")), F.lit("_"), stem)), F.lit(".md"))
