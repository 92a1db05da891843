"""The whole job on a small folder: learned boilerplate and index pages go, a loop ends the pages of its site."""

from quire.plans.chapters import chapters

PROSE = "The ferry crossed the river at dawn and number {} of the lanterns went out before anyone on the far bank could count them all again."


def page(n: int, *more: str, title: str = "Story") -> str:
    body = "".join(f"<p>{t}</p>" for t in (PROSE.format(n), *more, PROSE.format(f"{n} and a half")))
    return f"<html><head><title>{title}</title></head><body><div class='text'><h1>Chapter {n}</h1>{body}</div></body></html>"


def test_boilerplate_index_pages_and_loops(spark, tmp_path):
    site, other = "http://www.saltfold.example/s/9/chapters", "http://inkmill.test/s/4/chapters"
    mark = "Proofread by the volunteers of Saltfold (batch {})"
    rows = [(n, n, page(n, mark.format(n)), f"{site}/{n}", None, {"story_name": "A"}) for n in (1, 2)]
    rows += [(3, 3, page(3, title="A: table of contents"), "http://saltfold.example/toc", None, {"story_name": "A"})]
    rows += [(4, 4, page(4), f"{site}/4", None, {"story_name": "A"}), (5, 4, page(4), f"{site}/4?x=1", None, {"story_name": "A"})]
    loop = page(2, mark.format(2)).replace("Chapter 2", "Chapter 5")
    rows += [(6, 5, loop, f"{site}/5", None, {"story_name": "A"}), (7, 6, page(6), f"{site}/6", None, {"story_name": "A"})]
    rows += [(8, 7, page(7, mark.format(7)), f"{other}/7", None, {"story_name": "A"})]  # another site: no loop, keywords of its own
    rows += [(20 + n, n, page(n, "Scanned for you by the salt guild"), None, "inbox/b.epub", {"story_name": "B"}) for n in range(1, 13)]
    spark.createDataFrame(
        rows, "raw_id long, chapter_index int, html string, source_url string, source_path string, metadata map<string,string>"
    ).selectExpr("*", "timestamp'2024-01-01' as ingested_at").write.parquet(f"{tmp_path}/raw_documents.parquet")
    spark.createDataFrame(
        [("saltfold.example", None, None, None, None, ["proofread by the volunteers of saltfold (batch"])],
        "domain string, content_selector string, next_selector string, title_selector string, remove_selectors array<string>, ads_keywords_learned array<string>",
    ).write.parquet(f"{tmp_path}/site_profiles.parquet")
    got = {r.raw_id: r.body for r in chapters(spark, str(tmp_path)).collect()}
    assert sorted(i for i in got if i < 20) == [1, 2, 4, 8]
    assert not any("volunteers" in got[i] for i in (1, 2)) and "volunteers" in got[8]
    assert len([i for i in got if i > 20]) == 12 and not any("salt guild" in got[i] for i in got if i > 20)
    earlier = spark.createDataFrame([("inkmill.test", "volunteers of saltfold")], "domain string, keyword string")
    assert not any("volunteers" in r.body for r in chapters(spark, str(tmp_path), earlier).collect())
