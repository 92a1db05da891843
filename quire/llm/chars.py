"""One consistent form of text: what looks the same becomes the same characters.

Compatibility decomposition, look-alike letters mapped, blanks mapped, characters that show nothing removed,
canonical composition; full case folding as a further step. All functions take and return Python strings and are
applied once per distinct value of an Arrow batch.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash

# Letters of other scripts that have the shape of a Latin letter (Unicode confusables, single letters).
LOOK_ALIKE = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԁ": "D", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Һ": "H", "Ӏ": "I",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ү": "y", "Ѵ": "V",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "γ": "y", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "σ": "o",
    "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J", "κ": "k", "χ": "x",
    # Armenian
    "օ": "o", "Օ": "O", "ս": "u", "Տ": "S", "հ": "h", "ո": "n", "ք": "p", "զ": "q", "ց": "g",
    # Latin letters of their own with the shape of another
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "Y", "ʋ": "v",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꮖ": "I", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L",
    "Ꮇ": "M", "Ꮲ": "P", "Ꮢ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}

# Ranges of the Default_Ignorable_Code_Point property.
IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)


def _table() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(k): v for k, v in LOOK_ALIKE.items()}
    for low, high in IGNORABLE:
        table.update((c, None) for c in range(low, high + 1))
    for c in range(0x3001):
        if unicodedata.category(chr(c)) == "Zs":
            table[c] = " "
    # blanks that are controls or separators; a line feed stays
    table.update((c, " ") for c in (0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0x2028, 0x2029, 0x2800))
    return table


TABLE = _table()
_ODD_ASCII = re.compile("[\t\x0b\x0c\r\x1c-\x1f]")


def look(text: str) -> str:
    """The consistent form with letter case kept: equal exactly where two texts render alike. Line feeds stay."""
    if text.isascii():
        return _ODD_ASCII.sub(" ", text) if _ODD_ASCII.search(text) else text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFKD", text).translate(TABLE))


# Small letters whose capitals have the shape of a Latin capital, though they themselves have not.
CAPITAL_ALIKE = str.maketrans("вкмнт", "bkmht")


def fold(form: str) -> str:
    """Full case folding of a consistent form, brought to composed form again.

    A capital may have been mapped where its small letter was not, so the small letter follows it.
    """
    return form.lower() if form.isascii() else unicodedata.normalize("NFKC", form.casefold()).translate(CAPITAL_ALIKE)


def per_distinct(values: pa.Array | pa.ChunkedArray, function) -> list:
    """`function` of each value, computed once per distinct value; null stays null."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    coded = values.dictionary_encode()
    done = [function(v) for v in coded.dictionary.to_pylist()]
    return [None if i is None else done[i] for i in coded.indices.to_pylist()]


def h64(text: str, seed: int = 0) -> int:
    """Signed 64-bit hash."""
    x = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed)
    return x - (1 << 64) if x >> 63 else x


def h128(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))


def _letters() -> np.ndarray:
    out = np.zeros(sys.maxunicode + 1, dtype=bool)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] in "LM":
            out[c] = True
    return out


_LETTER: np.ndarray | None = None


def is_letter() -> np.ndarray:
    """Table by code point: letters and combining marks."""
    global _LETTER
    if _LETTER is None:
        _LETTER = _letters()
    return _LETTER


def codes(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
