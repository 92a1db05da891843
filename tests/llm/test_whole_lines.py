"""Line features of problem 6 read the whole line."""

from quire.llm.p6_main import text_features


def test_middle_of_a_long_line_counts():
    filler = "the ferry crossed the grey river before dawn and nobody saw it leave "
    plain = filler * 8
    middle = filler * 4 + "please subscribe now " + filler * 4
    got = set(text_features(middle)) - set(text_features(plain))
    assert {"w:subscribe", "b:please subscribe", "b:subscribe now"} <= got
    out = text_features(plain)
    assert len(out) == len(set(out))  # as in training, where a feature counts once a line


def test_combining_marks_stay_with_their_letters():
    assert "w:हिन्दी" in text_features("यह हिन्दी है")
