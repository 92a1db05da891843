"""Problem 9: sentence boundaries across languages and scripts, by a finite transducer run as a parallel prefix scan.

A lexer turns each text into a tape of token classes: what kind of word stands before a sign, the sign, what follows it,
quotation marks, paragraph breaks, blanks of scripts without full stops. It decides nothing; whether a sentence ends is
said by the boundary rules, which are compiled into one transducer: state x symbol -> state, boundary or not. The symbols
of all texts of a batch form one tape that is cut into chunks; each chunk becomes its state-transition function, the
functions are composed by a parallel prefix scan, and a second sweep emits the boundaries of all chunks at once. A
text of any length therefore costs a number of vector steps that depends on the chunk length, not on the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations after which a sentence goes on, whatever follows.
GOES_ON = frozenset(
    """
    Mr Mrs Ms Dr Prof Capt Col Gen Lt Sgt St Mt Rev Hon Vol vol Vols cf vs approx Fig fig Nos pp ed eds trans
    Bd Bde vgl Vgl Nr ca Hr Fr Hrn Frl usw_ bzw evtl ggf Str Abs Kap
    M MM Mme Mmes Mlle env art Art chap vol
    Sr Sra Srta Dra Ud Uds aprox núm Núm pág Pág págs ej Lic Ing Av
    стр рис ул см См гл им напр тыс др Др проф
    tr TP BS TS GS ThS PGS
    पृ डॉ पं श्री ดร นาย พ
    """.split()
)
# Abbreviations after which a sentence goes on where a digit follows.
BEFORE_NUMBER = frozenset("no No Nos nr p P S tr sec ch Ch art No".split())
# Last letters of dotted abbreviations that may end a sentence before a capital.
MAY_END = frozenset(["a.m", "p.m", "v.v", "A.M", "P.M"])

# Symbols of the tape. Every paragraph begins with PARA, or with HEAD if it is a heading.
_SYMBOLS = """
PARA HEAD OPEN OPEN_CLEAN CLOSE BLANK SPEECH_END
W_NEVER W_NUMBER W_ORDINAL W_UNCASED
S_STOP S_STOP_CALL S_CALL S_CALL_STOP S_DOTS S_DOTS_CALL S_WIDE S_DANDA
Q_STOP Q_STOP_CALL Q_CALL Q_CALL_STOP Q_DOTS Q_DOTS_CALL Q_WIDE Q_DANDA
N_LAST N_GLUED N_UPPER N_LOWER N_DIGIT N_CASELESS N_OTHER N_QUOTATIVE
NOTHING
""".split()
CODE = {name: k for k, name in enumerate(_SYMBOLS)}
# W_: the word before a sign, if it is no plain one: never ends a sentence, goes on before a number, or before a capital,
# or is of a script without case that has full stops, so that a letter without case may follow.
# S_: a sign, Q_: a sign with a closing mark behind it. _CALL: the last sign is an exclamation, question mark or ellipsis.
# N_: what follows: nothing or an empty line, no blank, a capital, a small letter, a digit, a letter without case, other
# signs, a particle that quotes. OPEN: a quotation mark with text between it and the symbol before, OPEN_CLEAN: without.

# Where the sentence stands. START: nothing of it yet; SPEECH: inside quotation marks that began it; TOLD: after such
# speech, in the words that attribute it; PLAIN; QUOTE: inside quotation marks within it; TITLE: a heading.
PLACES = ("START", "SPEECH", "TOLD", "PLAIN", "QUOTE", "TITLE")

# What follows a sign so that the sentence may end there; the word before it takes away from this.
_ENDS_BEFORE = {
    "STOP": {"N_UPPER", "N_DIGIT"},
    "CALL": {"N_UPPER", "N_DIGIT", "N_CASELESS"},
    "DOTS": {"N_UPPER", "N_DIGIT"},
    "WIDE": {"N_GLUED", "N_UPPER", "N_LOWER", "N_DIGIT", "N_CASELESS", "N_OTHER"},
    "DANDA": {"N_GLUED", "N_UPPER", "N_LOWER", "N_DIGIT", "N_CASELESS", "N_OTHER", "N_QUOTATIVE"},
}
_ENDS_ALSO_BEFORE = {"W_UNCASED": {"N_CASELESS"}}
_GOES_ON_BEFORE = {"W_NEVER": {"N_UPPER", "N_DIGIT"}, "W_NUMBER": {"N_DIGIT"}, "W_ORDINAL": {"N_UPPER"}}

# The rules of the places: event -> for each of START, SPEECH, TOLD, PLAIN, QUOTE the next place; * marks a boundary.
_RULES = {
    "end": ("START*", "SPEECH*", "START*", "START*", "QUOTE*"),
    "no end": ("PLAIN", "SPEECH", "TOLD", "PLAIN", "QUOTE"),
    "open": ("QUOTE", "SPEECH", "QUOTE", "QUOTE", "QUOTE"),  # text stands before the mark
    "open clean": ("SPEECH", "SPEECH", "QUOTE", "QUOTE", "QUOTE"),  # the mark begins the sentence
    "close": ("PLAIN", "TOLD", "TOLD", "PLAIN", "PLAIN"),  # no end inside the mark, or the sentence plainly goes on
    "close call": ("START*", "TOLD", "START*", "START*", "START*"),  # ! or ? inside the mark: attribution may follow
    "close stop": ("START*", "START*", "START*", "START*", "START*"),  # full stop inside the mark
    "blank": ("START*", "SPEECH", "START*", "START*", "QUOTE"),  # blank that ends a sentence in scripts without stops
}


def _step(place: str, word: str, sign: str, symbol: str) -> tuple[tuple[str, str, str], bool]:
    """One step of the machine the rules describe: its state is a place, a word class and a sign waiting for what follows."""

    def take(event: str) -> tuple[tuple[str, str, str], bool]:
        to = _RULES[event][PLACES.index(place)]
        return (to.rstrip("*"), "", ""), to.endswith("*")

    if symbol == "NOTHING":  # fills up a chunk
        return (place, word, sign), False
    if symbol in ("PARA", "HEAD"):
        return ("START" if symbol == "PARA" else "TITLE", "", ""), True
    if place == "TITLE":
        return (place, "", ""), False
    if symbol.startswith("W_"):
        return (place, symbol, ""), False
    if symbol[:2] in ("S_", "Q_"):
        return (place, word, symbol), False
    if symbol.startswith("N_") and sign:
        kind, _, call = sign[2:].partition("_")
        ends = symbol in _ENDS_BEFORE[kind] or kind == "STOP" and symbol in _ENDS_ALSO_BEFORE.get(word, ())
        ends = ends and not (kind == "STOP" and symbol in _GOES_ON_BEFORE.get(word, ()))
        if sign.startswith("S_"):
            return ((place, "", ""), False) if symbol == "N_LAST" else take("end" if ends else "no end")
        calls = kind == "WIDE" or (call == "CALL" if call else kind == "CALL")
        return take(("close call" if calls else "close stop") if ends else "close")
    event = {"OPEN": "open", "OPEN_CLEAN": "open clean", "CLOSE": "close", "BLANK": "blank", "SPEECH_END": "close call"}.get(symbol)
    return take(event) if event else ((place, "", ""), False)


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """The transducer's tables, next state and boundary by state and symbol: all states the rules reach, equal ones merged.

    The first states are the places themselves; in the others a word or a sign waits for what follows.
    """
    states = [(place, "", "") for place in PLACES]
    moves: list[list[tuple[int, bool]]] = []
    known = {state: k for k, state in enumerate(states)}
    for state in states:  # grows while it is walked
        row = []
        for symbol in _SYMBOLS:
            to, cut = _step(*state, symbol)
            if to not in known:
                known[to] = len(states)
                states.append(to)
            row.append((known[to], cut))
        moves.append(row)
    group = [0] * len(states)
    while True:  # states are equal if they emit and lead to the same
        signs = [tuple((group[to], cut) for to, cut in row) for row in moves]
        fresh = {sign: k for k, sign in enumerate(dict.fromkeys(zip(group, signs, strict=True)))}
        merged = [fresh[g, s] for g, s in zip(group, signs, strict=True)]  # numbered as they are met: the places come first
        if len(set(merged)) == len(set(group)):
            break
        group = merged
    step = np.zeros((len(set(group)), len(_SYMBOLS)), dtype=np.uint8)
    emit = np.zeros(step.shape, dtype=bool)
    for k, row in enumerate(moves):
        step[group[k]] = [group[to] for to, _ in row]
        emit[group[k]] = [cut for _, cut in row]
    return step, emit


STEP, CUT = _compile()
_WAITING = np.array([name[:2] in ("W_", "S_", "Q_") for name in _SYMBOLS])

_EVENT = re.compile(
    r"(\n[^\S\n]*\n\s*)"  # 1 paragraph break
    r"|([.!?…\u061f\u06d4]+(?:[)\]]|[    ]?»|”|’(?!\w)|[\"“](?!\w)|[』」])*)"  # 2 end of the scripts with blanks
    r"|([。！？．｡]+[」』”’）)》〉\"]*)"  # 3 end of the scripts without blanks
    r"|([।॥]+[\"”’)]*)"  # 4 danda
    r"|([\"“”„«»「」『』])"  # 5 quotation mark
    r"|((?<=[ก-๛຀-໿])[^\S\n]*\n?[^\S\n]*(?<=\s)(?=[ก-ๅํ-๛຀-໅]))"  # 6 blank between Thai or Lao letters
)
_WORD = re.compile(r"[^\W\d_]+(?:[.-]{1,2}[^\W\d_]+)*\Z")
# A numbered title, or a Thai chapter title: a paragraph of its own that ends without a stop.
_HEADING = re.compile(r"\s*(?:(?:บทที่|ตอนที่)\s*\d+|\d{1,4}[.)](?=\s))[^\n.!?…。！？।]{0,120}(?:\n[^\S\n]*\n|\s*\Z)")
_NUMBERED = re.compile(r"\s*\d{1,4}[.)]?\Z")
_ORDINAL = re.compile(r"(?:^|[^\W\d_]|\s)(?:[Aa]m|[Ii]m|[Dd]er|[Dd]ie|[Dd]as|[Dd]em|[Dd]en|[Dd]es|[Vv]om|[Zz]um|[Zz]ur|[Bb]eim|[Ss]eit)\s+\d{1,3}\Z")
_AT_HOUR = re.compile(r"(?:^|[.!?…][\"”»]?\s|\n)\s*[\"“«]?[A-ZÀ-Þ]\w{0,4}\s+\d[\d:.]*\s+\Z")
_CLOSERS = "\"“”’»』」"
_CASELESS = re.compile(r"[ऀ-෿฀-໿က-႟぀-ヿ㐀-鿿가-힯֐-ۿ]")
_STOPPED = re.compile("[\u0590-\u07ff\uac00-\ud7af]")  # Hebrew, Arabic, Syriac, Hangul
_OPENERS = "\"“„«「『(¿¡[—–-‘’'*_"


def _next(text: str, i: int) -> tuple[str, str]:
    """What follows position i: the blank's first character or '', and the class of the next letter or digit.

    Classes: U capital, L small letter, D digit, C letter without case, Q a sentence's opening sign before anything,
    - dash before a small letter, . other, '' the end or an empty line.
    """
    n, j = len(text), i
    while j < n and text[j].isspace():
        j += 1
    if j == n or text.count("\n", i, j) > 1:
        return "", ""
    blank = text[i] if j > i else ""
    k = j
    while k < n and k < j + 6 and (text[k] in _OPENERS or text[k].isspace()):
        k += 1
    if k == n:
        return blank, "."
    c = text[k]
    if c.isupper():
        return blank, "U"
    if c.islower():
        return blank, "L"
    if c.isdigit():
        return blank, "D"
    if _CASELESS.match(c):
        return blank, "C"
    return blank, "."


def _word_before(text: str, start: int) -> str:
    """Class of what stands before a full stop: a W_ symbol, or '' for a plain word."""
    if _CASELESS.match(before := text[start - 1] if start else ""):
        return "W_UNCASED" if _STOPPED.match(before) else "W_NEVER"  # a full stop ends no sentence of the others
    word = _WORD.search(text, max(0, start - 16), start)
    if word is None:
        if _ORDINAL.search(text, max(0, start - 12), start):
            return "W_ORDINAL"
        head = text[max(0, start - 8) : start]
        if _NUMBERED.match(head.rsplit("\n", 1)[-1]) and (start < 8 or "\n" in head):
            line = text.rfind("\n", 0, start) + 1
            first = line == 0 or text[:line].rstrip(" \t").endswith("\n\n")
            return "W_NEVER" if first and text[line:start].strip().isdigit() else ""
        return ""
    w = word.group()
    if w in GOES_ON:
        return "W_NEVER"
    parts = re.split(r"[.-]+", w)
    last = w.rpartition(".")[2]
    if "." in w and len(last.lstrip("-")) == 1:
        return "" if w in MAY_END and not _AT_HOUR.search(text, max(0, word.start() - 24), word.start()) else "W_NEVER"
    if "." in w and last in GOES_ON or all(len(part) == 1 for part in parts):  # an initial, or letters joined by stops
        return "W_NEVER"
    return "W_NUMBER" if w in BEFORE_NUMBER else ""


_NEXT = {"U": CODE["N_UPPER"], "L": CODE["N_LOWER"], "D": CODE["N_DIGIT"], "C": CODE["N_CASELESS"], ".": CODE["N_OTHER"]}
_DASHES = " \n\t\u00a0\u3000—–-¡¿"  # may stand between the start of a sentence and its quotation mark


def lex(text: str) -> tuple[list[int], list[int]]:
    """Symbols of a text, and the position of each: where the next sentence could begin."""
    code = CODE
    lead = len(text) - len(text.lstrip())
    symbols = [code["HEAD" if _HEADING.match(text, lead) else "PARA"]]
    at = [lead]
    add, put = symbols.append, at.append
    for m in _EVENT.finditer(text, lead):
        g = m.lastindex
        s, e = m.span()
        if g == 1:
            add(code["HEAD" if _HEADING.match(text, e) else "PARA"])
            put(e)
        elif g == 5:
            c = m.group()
            if c in "„«「『":
                opens = True
            elif c in "”»」』":
                opens = False
            elif c == "“":
                opens = e < len(text) and (text[e].isalnum() or text[e] in "¿¡…'‘—-([" or _CASELESS.match(text[e]) is not None)
            else:
                before = text[s - 1] if s else " "
                opens = (before.isspace() or before in "([—–-:¿¡“「") and e < len(text) and not text[e].isspace()
            if opens:
                add(code["OPEN" if text[at[-1] : s].strip(_DASHES) else "OPEN_CLEAN"])
            else:
                blank, kind = _next(text, e)
                add(code["SPEECH_END" if blank and kind == "C" and "ก" <= text[s - 1] <= "໿" else "CLOSE"])
            put(e)
        elif g == 6:
            if text[s - 1] != "ๆ" and text[e] != "ๆ":
                add(code["BLANK"])
                put(e)
        else:
            signs = m.group()
            body = signs.rstrip(_CLOSERS + ")]）》〉\u00a0\u2009\u202f ")
            closed = any(c in _CLOSERS for c in signs[len(body) :])
            if g == 2:
                kind = "DOTS" if body.startswith("..") or body[0] == "…" else "STOP" if body[0] in ".\u06d4" else "CALL"
                kind += "_CALL" if kind != "CALL" and body[-1] in "!?…\u061f" else "_STOP" if kind == "CALL" and body[-1] in ".\u06d4" else ""
                if kind.startswith("STOP") and (word := _word_before(text, s)):
                    add(code[word])
                    put(e)
            else:
                kind = "WIDE" if g == 3 else "DANDA"
            add(code[("Q_" if closed else "S_") + kind])
            put(e)
            blank, after = _next(text, e)
            if after == "":
                add(code["N_LAST"])
            elif g == 3 and text.startswith(("と", "って"), e):
                add(code["N_QUOTATIVE"])
            elif not blank:
                add(code["N_GLUED"])
            else:
                add(_NEXT[after])
            put(e)
    return symbols, at


def scan(symbols: np.ndarray, chunk: int = 64) -> np.ndarray:
    """Whether each symbol of the tape is a boundary. Every text's symbols begin with PARA or HEAD.

    The tape is cut into chunks, none between a sign and what follows it, so a chunk begins and ends in one of the places.
    Sweep one steps all chunks together and yields each chunk's function from place to place; the functions are composed
    by a Hillis-Steele prefix scan; sweep two steps all chunks from their now known first place and emits.
    """
    n = len(symbols)
    if n == 0:
        return np.zeros(0, dtype=bool)
    first = np.arange(0, n, chunk)
    while (late := _WAITING[symbols[np.minimum(first, n) - 1]] & (first > 0) & (first < n)).any():
        first = first + late
    first = np.unique(first[first < n])
    size = np.diff(np.append(first, n))
    lanes, width = len(first), int(size.max())
    at = first[:, None] + np.arange(width)
    inside = np.arange(width) < size[:, None]
    tape = np.where(inside, symbols[np.minimum(at, n - 1)], CODE["NOTHING"])
    functions = np.tile(np.arange(len(PLACES), dtype=np.uint8), (lanes, 1))
    for i in range(width):
        functions = STEP[functions, tape[:, i, None]]
    reach = 1
    while reach < lanes:  # functions[k] becomes the composition of all chunks up to k
        later = functions.copy()
        later[reach:] = np.take_along_axis(functions[reach:], functions[:-reach], axis=1)
        functions, reach = later, reach * 2
    state = np.concatenate(([0], functions[:-1, 0])).astype(np.uint8)
    out = np.empty((lanes, width), dtype=bool)
    for i in range(width):
        out[:, i] = CUT[state, tape[:, i]]
        state = STEP[state, tape[:, i]]
    return out[inside]


_SAYS = re.compile(r"[^\W_]")


def spans_of(texts: list[str]) -> list[list[tuple[int, int]]]:
    """Start and end (from 0, end excluded) of each sentence of each text; a unit without letter or digit is none."""
    tape: list[int] = []
    places: list[list[int]] = []
    for t in texts:
        symbols, at = lex(t)
        tape += symbols
        places.append(at)
    cuts = scan(np.array(tape, dtype=np.uint8))
    out, i = [], 0
    for t, at in zip(texts, places, strict=True):
        chosen = np.asarray(at)[cuts[i : i + len(at)]].tolist()
        i += len(at)
        found = []
        for a, b in zip(chosen, [*chosen[1:], len(t)], strict=True):
            while a < b and t[a].isspace():
                a += 1
            if a < b and _SAYS.search(t, a, b):
                found.append((a, b))
        out.append(found)
    return out


def starts_of(texts: list[str]) -> list[list[int]]:
    """1-based start of each sentence of each text."""
    return [[a + 1 for a, _ in found] for found in spans_of(texts)]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        at, size = 0, 0
        for i, t in enumerate(texts, 1):  # parts of a few million characters bound the memory
            size += len(t)
            if size > 4_000_000 or i == len(texts):
                starts = starts_of(texts[at:i])
                rows = np.repeat(np.arange(at, i), [len(s) for s in starts])
                flat = [s for each in starts for s in each]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows, pa.int64())), pa.array(flat, pa.int32())], names=["id", "sent_start"]
                )
                at, size = i, 0


def sentence_starts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sent_start): one row per sentence, sent_start from 1 in characters. Null and empty texts give no row.

    One Arrow pass without an exchange; whole texts, repeated rows are divided each.
    """
    kind = df.schema[id_col].dataType.simpleString()
    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return chosen.mapInArrow(_batches, f"id {kind}, sent_start int")


def sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sent_no, sent_start, sentence): the sentence units themselves, blanks at their ends removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            row, no, start, said = [], [], [], []
            for i, (t, found) in enumerate(zip(texts, spans_of(texts), strict=True)):
                for k, (a, b) in enumerate(found, 1):
                    row.append(i)
                    no.append(k)
                    start.append(a + 1)
                    said.append(t[a:b].strip())
            columns = [ids.take(pa.array(row, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int32()), pa.array(said, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "sent_no", "sent_start", "sentence"])

    kind = df.schema[id_col].dataType.simpleString()
    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return chosen.mapInArrow(run, f"id {kind}, sent_no int, sent_start int, sentence string")
