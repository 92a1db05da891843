"""Garbled text that is common in a corpus must not make itself look probable."""

import numpy as np
import pyarrow as pa

from quire.llm import p5_encoding as p5


def _wrong(text: str) -> str:
    table = {b: c for c, b in p5._WRONG["cp1252"].items()}
    return "".join(chr(table[b]) for b in text.encode())


SOUND = [f"Capítulo {i}: el capitán volvió – otra vez – al sótano número {i}." for i in range(400)]


def _model(texts):
    made = next(p5._count(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])])))
    return p5.Model(made.column(0).to_numpy(), made.column(1).to_numpy())


def test_half_of_a_corpus_garbled():
    restorer = p5.Restorer(_model(SOUND + [_wrong(t) for t in SOUND]))
    for t in SOUND[::40]:
        assert p5.repair(_wrong(t), restorer) == (True, t, True)
        assert p5.repair(t, restorer) == (False, t, True)


def test_runs_that_read_as_utf8_are_marked():
    text = "\nsótano Ã³ tú â€“ x – y\n"
    marked = p5.Doubt().mark(text, p5.codes(text))
    assert "".join(c for c, m in zip(text, marked, strict=True) if m) == "Ã³â€“"
    assert p5.Doubt().mark("\nplain ascii\n", p5.codes("\nplain ascii\n")) is None


def test_look_alikes_and_broken_sequences():
    restorer = p5.Restorer(_model(SOUND))
    assert p5.repair("el sótаno dеl cаpitán", restorer)[0] is False  # Cyrillic letters of the same shape
    assert p5.repair("volvió â€ otra vez", restorer)[0]  # a byte was lost
    assert p5.repair("", restorer) == (False, "", True)


def test_ideographs_by_use():
    common, rare = p5.symbols(np.array([ord("的"), ord("鐨")]))
    assert common != rare and p5.SYMBOLS < 4000
