"""Learning operators that SQL cannot state, and the guards of shared tables."""

import pytest
from pyspark.sql import functions as F

from quire.operators import guards, learning, render, shared


def test_answers_are_made_whole(spark):
    df = spark.createDataFrame([("^a(\\d+)$",), ("(",), ("",), (None,)], "p string")
    assert [r.v for r in df.select(learning.valid_pattern("p").alias("v")).collect()] == ["^a(\\d+)$", None, None, None]
    answers = ['{"tables": true, "system_box": {"found": true, "selectors": [".s"]}, "image_alt_text": true}', "no json", None]
    got = [r.r for r in spark.createDataFrame([(a,) for a in answers], "a string").select(learning.formatting_rules(F.col("a")).alias("r")).collect()]
    assert got[0].tables and got[0].system_box.selectors == [".s"] and got[0].image_alt_strategy == "preserve"
    assert got[1] == got[2] and got[1].bold_italic and not got[1].tables and got[1].author_note.selectors == [] and got[1].image_alt_strategy == "skip"


def test_retro_cleaning(spark):
    own = lambda i: "\n".join(f"line {k} of the own text of chapter {i}" for k in range(12))
    rows = [("s", f"please support us on our page\n{own(i)}" + ("\nread along with friends" if i % 2 else "")) for i in range(12)]
    docs = spark.createDataFrame([*rows, ("t", None), ("s", "")], "domain string, text string")
    none = spark.createDataFrame([], "domain string, keyword string")
    out = learning.retro_cleaned(docs, F.col("domain"), "text", none)
    assert out.where(F.col("text").contains("support us")).count() == 0 and out.where(F.col("text").contains("friends")).count() == 6
    verdicts = spark.createDataFrame([("s", "read along with friends")], "domain string, line string")
    assert learning.retro_cleaned(docs, F.col("domain"), "text", none, verdicts).where(F.col("text").contains("friends")).count() == 0
    known = spark.createDataFrame([("s", "please support us on our page")], "domain string, keyword string")
    assert learning.retro_cleaned(docs, F.col("domain"), "text", known).where(F.col("text").contains("support us")).count() == 12


def test_names_and_prefixes(spark):
    rows = [("a", 1, "The Long Road 1"), ("a", 2, "The Long Road 2: Rain"), ("a", 3, None), ("b", 1, "x"), ("c", 1, None)]
    got = learning.story_names(spark.createDataFrame(rows, "s string, i int, t string"), "s", ["i"], "t").collect()
    assert {r.s: r.name for r in got} == {"a": "The Long Road", "b": None}


def test_walks_with_loops_and_ends(spark):
    links = spark.createDataFrame([(f"p{i}", f"p{i + 1}") for i in range(70)] + [("x", "y"), ("y", "z"), ("z", "y"), ("self", "self"), ("n", None)], "url string, next_url string")
    starts = spark.createDataFrame([("p0",), ("x",), ("self",), ("n",), ("x",)], "url string")
    got = {(r.start, r.step, r.url) for r in guards.walk(links, starts).collect()}
    assert got == {("p0", i, f"p{i}") for i in range(71)} | {("x", 0, "x"), ("x", 1, "y"), ("x", 2, "z"), ("self", 0, "self"), ("n", 0, "n")}
    assert guards.walk(links, starts.where("url = 'p0'"), most=9).count() == 10
    assert guards.walk(links, starts.where("false")).count() == 0


def test_indent_keeps_code(spark, one):
    e = render.INDENT
    cases = {"a\n```\nb\n```\nc": f"{e}a\n```\nb\n```\n{e}c", "```\nx": "```\nx", "": "", "\n\na": f"\n\n{e}a", "# h\n  ```\n- b\n```\n> q\n1. x": "# h\n  ```\n- b\n```\n> q\n1. x"}
    for text, want in cases.items():
        assert one(render.indent, t=text) == want


def test_shared_folder_is_required_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, other=None: other)})()

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared.shared_dir(Session())


def test_broadcast_only_where_small(spark):
    df = spark.range(20)
    plan = lambda most: spark.range(5).join(shared.sized_broadcast(df, "t", most), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(100) and "strategy=broadcast" not in plan(10)
