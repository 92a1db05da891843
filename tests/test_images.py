"""References to images of a book whose items share a base name."""

from quire.operators import render


def test_prefix_variants_before_the_base_name(spark):
    refs = spark.createDataFrame([("b", "images/1.png"), ("c", "../images/1.png")], "book string, href string")
    items = [("b", "A/extra/1.png", "x"), ("b", "OEBPS/images/1.png", "y"), ("c", "A/1.png", "x"), ("c", "OPS/images/1.png", "y")]
    got = render.match_images(refs, spark.createDataFrame(items, "book string, file string, content string"))
    assert {r.book: r.file for r in got.collect()} == {"b": "OEBPS/images/1.png", "c": "OPS/images/1.png"}
