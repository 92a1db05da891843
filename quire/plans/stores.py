"""Queries of the stores, renderings, walks and choices around the pipeline, each with the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.functions import urls as U
from quire.operators import agents, boilerplate, chapters, fetching, guards, learning, lines, naming, profiles, render
from quire.plans.queries import _BLANKS, _CHALLENGE, _EDGES, _FP, _is_keyword, _lines, _list, _matches, _segments, _strip, edge_candidates, query
from quire.sources import files
from quire.sources.tables import table

# ---- addresses and titles ---------------------------------------------------------------------------------------------

_HOST = r"lower(regexp_extract(start_url, '(?i)^\s*[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#\s]+)', 1))"


@query(
    rf"""with a as (select story_id, start_url, list_filter({_segments("start_url")}, lambda x: not regexp_matches(x, '^\d+$') and length(x) > 3)[-1] as slug from story_progress),
    b as (select *, trim(regexp_replace(regexp_replace(regexp_replace(slug, '(?i)(?:chapter|chap|ch|episode|ep|part)[_-]?\d+', '', 'g'), '^[-_ ]+|[-_ ]+$', '', 'g'), '[-_]+', ' ', 'g')) as w from a)
    select story_id, case when coalesce(regexp_matches(start_url, '(?i)^https?://[^/?#]+'), false) and length(w) >= 3
        then array_to_string(list_transform(string_split(lower(w), ' '), lambda x: upper(x[1]) || x[2:]), ' ') end as title,
      rpad(string_split(replace(case when starts_with(start_url, 'http') then {_HOST} else lower(start_url) end, 'www.', ''), '.')[1][1:12], 12, ' ') as tag from b"""
)
def slug_titles(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("start_url")
    return table(spark, d, "story_progress").select("story_id", U.title_from_slug(u).alias("title"), U.domain_tag(u).alias("tag"))


@query(
    """select doc_id, case when length(title) < 2 or regexp_matches(title, '(?i)^a\\s+\\S.{2,70}\\s+fanfic(?:tion)?\\s*$|^(?:translated|edited)\\s+by\\b|^(?:official\\s+)?(?:epub|pdf|translation)\\b')
        then true else length(title) > 60 and not regexp_matches(title, '[.!?,;:''"()]') end as garbage,
      case when length(title) <= 20 then title else title[1:19] || '…' end as short,
      case when regexp_matches(title, '^\\s*\\d+\\s*$') then case when trim(title)::int = 0 then 'Prologue' else 'Chapter ' || trim(title)::int end
        else coalesce(trim(title), 'Chapter ' || chapter_index) end as smart from documents"""
)
def title_choices(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return table(spark, d, "documents").select(
        "doc_id", naming.is_garbage(t).alias("garbage"), X.truncate(t, 20).alias("short"), chapters.smart_title(t, F.col("chapter_index")).alias("smart")
    )


# ---- walks and fetches ------------------------------------------------------------------------------------------------


@query(
    """with recursive n as (select url, min(next_url) as nxt from pipeline_contexts where next_url is not null group by url),
    w as (select distinct start_url as start, 0 as step, start_url as url, [start_url] as seen from story_progress where start_url is not null
      union all select w.start, step + 1, nxt, list_append(seen, nxt) from w join n on w.url = n.url where not list_contains(seen, nxt) and step < 5000)
    select start, step, url from w"""
)
def story_walks(spark: SparkSession, d: str) -> DataFrame:
    """Where the next links lead from the start of each story."""
    links = table(spark, d, "pipeline_contexts").select("url", "next_url")
    starts = table(spark, d, "story_progress").where("start_url is not null").select(F.col("start_url").alias("url"))
    return guards.walk(links, starts).select("start", "step", "url")


@query(
    """with u as (select distinct current_url as url from story_progress where current_url is not null),
    p as (select url, max(fetched_at) as fetched_at from pipeline_contexts where url is not null group by url)
    select url, fetched_at from u left join p using (url)"""
)
def prefetched(spark: SparkSession, d: str) -> DataFrame:
    urls = table(spark, d, "story_progress").where("current_url is not null").select(F.col("current_url").alias("url")).distinct()
    return fetching.prefer_prefetched(urls, table(spark, d, "pipeline_contexts").select("url", "html", "fetched_at")).select("url", "fetched_at")


@query(
    f"""with a as (select ctx_id, status_code as s, fetch_method = 'playwright' as b, html, coalesce(detected_js_heavy, false) as js, length(html) >= 100 and ({_CHALLENGE}) as ch from pipeline_contexts),
    c as (select ctx_id, case when b then html end as bh, case when not b then html end as ph, s, js, coalesce((s = 403) or (not b and ch), false) as blocked from a)
    select ctx_id, case when js and bh is not null then 'browser' when ph is not null and not blocked then 'plain' when bh is not null and ph is null then 'browser_fallback'
      when ph is not null then 'plain_blocked' end as method from c"""
)
def fetch_choices(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "pipeline_contexts")
    browser = F.col("fetch_method") == "playwright"
    html, status = F.col("html"), F.col("status_code")
    choice = fetching.fetched(F.when(~browser, html), status, F.when(browser, html), status, F.col("detected_js_heavy"))
    return c.select("ctx_id", choice["method"].alias("method"))


@query(
    f"""select distinct result_id, coalesce(regexp_matches(lower(error), '{"|".join(agents.RETRY)}'), false) as retry from block_results"""
)
def retries(spark: SparkSession, d: str) -> DataFrame:
    retry = agents.is_retriable(F.lit(None).cast("int"), F.col("error"))
    return table(spark, d, "block_results").select("result_id", retry.alias("retry")).distinct()


# ---- profiles and keywords --------------------------------------------------------------------------------------------


@query(
    """with n as (select domain, count(*) as stories, max(chapter_count) as most from story_progress where domain is not null group by domain),
    a as (select domain, p.confidence as c, n.stories / (n.stories + 10.0::double) as s, coalesce(n.most, 0) as most from site_profiles p left join n using (domain))
    select domain, round(case when coalesce(c, 0) <> 0 or coalesce(s, 0) <> 0 then (coalesce(c, 0.0) + coalesce(s, 0.0)) / ((coalesce(c, 0) <> 0)::int + (coalesce(s, 0) <> 0)::int)
      else 0.5 + 0.03 * least(most, 10) end, 2) as confidence from a"""
)
def profile_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of each profile from its own score and from how many stories its site has."""
    n = table(spark, d, "story_progress").where("domain is not null").groupBy("domain").agg(F.count("*").alias("stories"), F.max("chapter_count").alias("most"))
    p = table(spark, d, "site_profiles").select("domain", "confidence").join(n, "domain", "left")
    score = profiles.confidence([F.col("confidence"), F.col("stories") / (F.col("stories") + 10)], F.coalesce("most", F.lit(0)))
    return p.select("domain", score.alias("confidence"))


_SEEN = "(select domain, max(updated_at) as seen_at, min(start_url) as start_url from story_progress where domain is not null group by domain)"


@query(
    f"""with n as {_SEEN}, o as (select domain, last_learned as seen_at, null as start_url from site_profiles)
    select domain, seen_at, start_url from n union all select domain, seen_at, start_url from o where domain not in (select domain from n)"""
)
def profiles_upserted(spark: SparkSession, d: str) -> DataFrame:
    """The store of sites after the sites of the stories were written into it."""
    old = table(spark, d, "site_profiles").select("domain", F.col("last_learned").alias("seen_at"), F.lit(None).cast("string").alias("start_url"))
    new = table(spark, d, "story_progress").where("domain is not null").groupBy("domain").agg(F.max("updated_at").alias("seen_at"), F.min("start_url").alias("start_url"))
    return profiles.upsert(old, new, "domain")


@query(
    """select domain, profile_version from site_profiles where regexp_replace(domain, '^www\\.', '') not in
      (select regexp_replace(domain, '^www\\.', '') from story_progress where completed and domain is not null)"""
)
def profiles_left(spark: SparkSession, d: str) -> DataFrame:
    """Profiles after those of sites with a completed story were forgotten."""
    named = table(spark, d, "story_progress").where("completed and domain is not null").select("domain")
    return profiles.forget(table(spark, d, "site_profiles").select("domain", "profile_version"), named)


@query(
    f"""with {_EDGES}, r as (select *, row_number() over (partition by domain order by n desc, line) as rank from k where n >= 3),
    w as (select domain, {_strip("lower(line)")} as keyword from r where rank <= 20 and n >= 10
      union all select domain, {_strip("lower(k)")} from (select domain, unnest(ads_keywords_learned) as k from site_profiles)
      union all select d, k from (values {", ".join(f"('{dom}', '{k}')" for dom, ks in boilerplate.BUILT_IN.items() for k in ks)}) as b(d, k))
    select domain, list_sort(list(distinct keyword)) as keywords from w where keyword is not null and domain is not null and {_is_keyword("keyword")} group by domain"""
)
def keywords_merged(spark: SparkSession, d: str) -> DataFrame:
    """All keywords of each domain: learned from the documents, of the profiles, built in."""
    learned = edge_candidates(spark, d).where("kind = 'auto'").select("domain", F.col("line").alias("keyword"))
    words = boilerplate.keywords(learned, table(spark, d, "site_profiles"))
    return boilerplate.merge_keywords(words, words.limit(0)).where("domain is not null")


@query(
    """select domain, list_sort(list_distinct(list_concat(list_filter(coalesce(remove_selectors, []), lambda x: list_contains(ads, x)),
      list_filter(ads, lambda x: not list_contains(coalesce(remove_selectors, []), x))))) as selectors from (select domain, remove_selectors, coalesce(ads_keywords_learned, []) as ads from site_profiles)"""
)
def selectors_updated(spark: SparkSession, d: str) -> DataFrame:
    """The set algebra of a learning round: (current and safe) or (added without dangerous)."""
    current, ads = F.col("remove_selectors"), F.col("ads_keywords_learned")
    out = agents.updated_selectors(current, ads, ads, current)
    return table(spark, d, "site_profiles").select("domain", F.array_sort(out).alias("selectors"))


@query(
    """select ctx_id, case when length(trim(content)) >= 150 and validation_score >= 0.3 then md5(content) end as accepted,
      least(greatest(validation_score * 2 - 0.5, 0.0), 1.0) as clamped, coalesce(length(html) > length(content) * 1.5 and length(html) - length(content) > 500, false) as heavy,
      case when next_url = url then next_url else url end as link from pipeline_contexts"""
)
def answers_checked(spark: SparkSession, d: str) -> DataFrame:
    """The checks an answer of a model must pass, over the fields of the contexts."""
    c = F.col
    return table(spark, d, "pipeline_contexts").select(
        "ctx_id", F.md5(agents.accepted(c("content"), c("validation_score"))).alias("accepted"), agents.clamped(c("validation_score") * 2 - 0.5).alias("clamped"),
        profiles.script_heavy(F.length("html"), F.length("content")).alias("heavy"), agents.known_link(F.array("url"), c("next_url")).alias("link"),
    )


# ---- files, books, renderings -----------------------------------------------------------------------------------------


@query(
    f"""with a as (select source_path as path, list_filter(list_transform({_lines("html[1:8192]")}[1:5], lambda x: {_strip("x")}),
        lambda x: x <> '' and not starts_with(x, '#') and not starts_with(x, '!relearn')) as told from raw_documents where source_path is not null and html is not null)
    select path, case when ends_with(lower(path), '.epub') then 'epub' when ends_with(lower(path), '.txt') then case when coalesce(regexp_matches(told[1], '(?i)^https?://'), false) then 'web' else 'txt' end
      else 'web' end as kind from a"""
)
def input_kinds(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_documents").where("source_path is not null and html is not null")
    return files.input_kind(raw.select(F.col("source_path").alias("path"), F.encode("html", "utf-8").alias("content")))


_UNITS = """(select metadata['story_name'] as book, chapter_index as pos, raw_id as doc_id, source_path as file, metadata['toc_title'] as title from raw_documents where source_path is not null)"""


@query(
    f"""with s as (select *, lower(replace(string_split(file, '#')[1], chr(92), '/')) as href from {_UNITS}), t as (select * from s where title is not null),
    b as (select book, string_split(href, '/')[-1] as base, arg_min(title, doc_id) as t2 from t group by 1, 2), w as (select book, href, arg_max(title, doc_id) as t1 from t group by 1, 2)
    select doc_id, coalesce(t1, t2) as toc_title from s left join w on s.book = w.book and s.href = w.href left join b on s.book = b.book and string_split(s.href, '/')[-1] = b.base"""
)
def toc_matched(spark: SparkSession, d: str) -> DataFrame:
    """Titles of book units by whole href, else by file name, from the units that have one."""
    raw, meta = table(spark, d, "raw_documents").where("source_path is not null"), F.col("metadata")
    units = raw.select(meta["story_name"].alias("book"), F.col("chapter_index").alias("pos"), F.col("raw_id").alias("doc_id"), F.col("source_path").alias("file"), meta["toc_title"].alias("title"))
    toc = units.where("title is not null").select("book", F.col("doc_id").alias("ord"), F.col("file").alias("href"), "title")
    return chapters.match_toc(units.drop("title"), toc).select("doc_id", "toc_title")


@query(
    f"""with p as (select doc_id, title, list_filter(list_transform(regexp_split_to_array(text, '\\n{_BLANKS}*\\n'), lambda x: {_strip("x")}), lambda x: x <> '') as ps from documents)
    select doc_id, md5('<html><body><article><h1>' || title || '</h1>' || chr(10) || array_to_string(list_transform(ps, lambda x: '<p>' || replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br/>') || '</p>'), chr(10))
      || '</article></body></html>') as page from p"""
)
def text_pages(spark: SparkSession, d: str) -> DataFrame:
    page = chapters.to_page(F.col("title"), F.col("text"))
    return table(spark, d, "documents", spread=True).select("doc_id", F.md5(page).alias("page"))


_NAV = "'[← a' || doc_id || '](a' || doc_id || '.md) | [🏠 Index](' || '" + render.INDEX_FILE + "' || ')' || case when title is null then '' else ' | [' || doc_id || ' →](' || doc_id || '.md)' end"


@query(
    f"""with a as (select doc_id, {_NAV} as nav, {_strip("text")} as body from documents where text is not null)
    select doc_id, md5('<!-- nav-top -->' || chr(10) || nav || chr(10) || '<!-- /nav-top -->' || chr(10) || chr(10) || body || chr(10) || chr(10) || '---' || chr(10) || '<!-- nav-bottom -->' || chr(10) || nav
      || chr(10) || '<!-- /nav-bottom -->' || chr(10)) as content from a"""
)
def navigated(spark: SparkSession, d: str) -> DataFrame:
    """Documents with navigation at both ends, put in twice: the second time changes nothing."""
    docs = table(spark, d, "documents", spread=True).where("text is not null")
    key = F.col("doc_id").cast("string")
    prev, nxt = F.concat(F.lit("a"), key, F.lit(".md")), F.when(F.col("title").isNotNull(), F.concat(key, F.lit(".md")))
    once = docs.select("doc_id", prev.alias("p"), nxt.alias("n"), render.with_navigation(X.strip(F.col("text")), prev, nxt).alias("c"))
    return once.select("doc_id", F.md5(render.with_navigation(F.col("c"), F.col("p"), F.col("n"))).alias("content"))


# as Python shows a title: blanks that are no space by their code
_SHOWN = "replace(replace(replace(title, chr(92), chr(92) || chr(92)), chr(12288), chr(92) || 'u3000'), chr(160), chr(92) || 'xa0')"
_FENCES = "len(list_filter(rs[1:i - 1], lambda y: regexp_matches(y, '^\\s*```'))) % 2 = 1"


@query(
    f"""with a as (select doc_id, title, chapter_index, source, string_split(coalesce(text, ''), chr(10)) as rs from documents)
    select doc_id, concat_ws(chr(10), '---', 'title: ' || case when contains(title, '''') and not contains(title, '"') then '"' || {_SHOWN} || '"' else '''' || replace({_SHOWN}, '''', chr(92) || '''') || '''' end,
      'chapter_index: ' || chapter_index, 'source_path: ' || source, '---', '') || chr(10) || array_to_string(list_transform(rs, lambda x, i: case when {_strip("x")} = '' or {_FENCES}
        or regexp_matches(x, '^\\s*(?:#|>|[-*+]\\s|\\d+\\.\\s|---\\s*$|\\||<!--|!\\[|```)') then x else '{render.INDENT}' || x end), chr(10)) as content from a"""
)
def render_obsidian(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    out = render.rendered("obsidian", c("title"), c("chapter_index"), c("text"), F.lit(None).cast("string"), c("source"))
    return table(spark, d, "documents", spread=True).select("doc_id", out.alias("content"))


@query(
    f"""with a as (select doc_id, {_FP} as fp, title from documents where text is not null), o as (select doc_id, fp from a where doc_id % 3 > 0), n as (select doc_id, case when doc_id % 5 = 0 then 'x' else fp end as fp from a)
    select n.doc_id, n.fp as content from n left join o using (doc_id) where o.fp is null or o.fp <> n.fp"""
)
def files_changed(spark: SparkSession, d: str) -> DataFrame:
    """What a run would write again: files a store lacks (here every third) or holds otherwise (here every fifth)."""
    rows = table(spark, d, "documents", spread=True).where("text is not null").select("doc_id", X.fingerprint(F.col("text")).alias("content"))
    new = rows.withColumn("content", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("content")))
    return render.changed(new, rows.where("doc_id % 3 > 0"), ["doc_id"])


# ---- edges ------------------------------------------------------------------------------------------------------------


def _nav(x: str) -> str:
    return f"({x} = '' or {_matches(x, lines.WORD_COUNTS)} or (length({x}) <= 10 and regexp_matches({x}, '{lines.SHORT_LABEL}')) or list_contains(same, {x}))"


@query(
    f"""with a as (select ctx_id, content, {_lines("content")} as ls from pipeline_contexts where content is not null),
    b as (select *, list_transform(ls, lambda x: {_strip("x")}) as bare, len(ls) as n from a),
    c as (select *, bare[1:7] as top, list_reverse(bare[n - 6:n]) as bottom from b), s as (select *, list_filter(list_intersect(top, bottom), lambda x: x <> '') as same from c),
    e as (select *, coalesce(list_position(list_transform(top, lambda x: not {_nav("x")}), true) - 1, 7) as st, n - coalesce(list_position(list_transform(bottom, lambda x: not {_nav("x")}), true) - 1, 7) as en,
      list_filter(list_transform(bare, lambda x, i: case when x <> '' then i - 1 end), lambda i: i is not null) as filled from s where n >= 8),
    f as (select *, coalesce(list_min(list_filter(filled, lambda i: i >= st)), n) as st2 from e), g as (select *, greatest(en, least(st2 + 1, n)) as en2 from f),
    h as (select *, list_max(list_filter(filled, lambda i: i >= st2 and i < en2)) as last from g)
    select ctx_id, md5(case when last is null then content else array_to_string(ls[st2 + 1:last + 1], chr(10)) end) as trimmed from h union all select ctx_id, md5(content) from b where n < 8"""
)
def edges_trimmed(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "pipeline_contexts", spread=True).where("content is not null")
    return lines.passes(df.select("ctx_id", "content"), "content", {"trimmed": lines.without_edges}).select("ctx_id", F.md5("trimmed").alias("trimmed"))


# ---- learning ---------------------------------------------------------------------------------------------------------


@query(
    f"""select domain, coalesce(list_filter(list_concat(remove_selectors, ['SCRIPT', ' ', content_selector]), lambda x: {_strip("x")} <> '' and lower({_strip("x")}) not in {_list(learning.ALWAYS_DROPPED)}), []) as selectors,
      case when p.domain in (select domain from story_progress) then p.domain || ': conf=' || printf('%.2f', coalesce(confidence, 0.0)) || ' | content=' || coalesce('''' || content_selector || '''', 'None')
        || ' | nav=' || coalesce('''' || nav_type || '''', 'None') else p.domain || ': no profile' end as summary from site_profiles p"""
)
def profile_reports(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "site_profiles")
    known = table(spark, d, "story_progress").where("domain is not null").select("domain").distinct().withColumn("known", F.lit(True))
    selectors = learning.sanitised_selectors(F.concat(F.coalesce("remove_selectors", F.array().cast("array<string>")), F.array(F.lit("SCRIPT"), F.lit(" "), F.col("content_selector"))))
    summary = learning.profile_summary(F.col("domain"), F.coalesce("known", F.lit(False)), F.col("confidence"), F.col("content_selector"), F.col("nav_type"))
    return p.join(known, "domain", "left").select("domain", selectors.alias("selectors"), summary.alias("summary"))


_PREFIX = "list_max(list_filter(range(1, length(list_min(ts)) + 1), lambda i: list_min(ts)[1:i] = list_max(ts)[1:i]))"


@query(
    f"""with r as (select story_id, title, row_number() over (partition by story_id order by chapter_index nulls first, doc_id) as k from documents where title is not null and story_id is not null),
    g as (select story_id, list(title) as ts from r where k <= 5 group by story_id),
    n as (select story_id, regexp_replace(coalesce(list_min(ts)[1:{_PREFIX}], ''), '[\\s\\x{{3000}}\\-–—:|,.#(\\[0-9]+$', '') as name from g)
    select story_id, case when length(name) >= 3 then name end as name from n"""
)
def story_names(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("story_id is not null").select("story_id", "title", "chapter_index", "doc_id")
    return learning.story_names(docs, "story_id", ["chapter_index", "doc_id"], "title")


@query(
    f"""with a as (select doc_id, {_lines("text")} as ls, lang from documents where text is not null), b as (select *, len(ls) as n from a),
    s as (select *, list_transform([0, 1, 2], lambda k: ('0x' || md5(doc_id || ':' || k)[1:8])::bigint % greatest(n - 79, 1)) as st from b)
    select doc_id, case when n < 240 then true else len(list_filter(st, lambda p: len(list_filter(ls[p + 1:p + 80], lambda x: regexp_matches({_strip("x")}, '[.!?。]$'))) = 0)) = 0 end as holds from s"""
)
def patterns_held(spark: SparkSession, d: str) -> DataFrame:
    """Whether a pattern (here a line that ends a sentence) is met in three drawn chunks of each text."""
    docs = table(spark, d, "documents", spread=True).where("text is not null")
    return docs.select("doc_id", learning.pattern_holds(F.col("text"), F.lit("[.!?。]$"), F.col("doc_id")).alias("holds"))


@query(
    """select domain, 'profile' as origin from site_profiles union all select distinct domain, 'story' as origin from story_progress where domain is not null and domain not in (select domain from site_profiles)"""
)
def cases_appended(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "site_profiles").select("domain", F.lit("profile").alias("origin"))
    new = table(spark, d, "story_progress").where("domain is not null").select("domain", F.lit("story").alias("origin")).distinct()
    return learning.append_new(old, new, "domain")


@query("select domain, profile_version from site_profiles where regexp_matches(domain, '(?i)^[a-m].*\\.test$')")
def relearn_listing(spark: SparkSession, d: str) -> DataFrame:
    return learning.matching_profiles(table(spark, d, "site_profiles").select("domain", "profile_version"), r"^[a-m].*\.test$")


_INDEX = f"(not regexp_matches(coalesce(url, ''), '{U.CHAPTER}') and regexp_matches(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*([^?#]*)', 1), '{U.INDEX}'))"


@query(
    f"""with a as (select ctx_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*/[^/?#]*/[^/?#]*', 0) as story, {_INDEX} as idx from pipeline_contexts where url is not null),
    b as (select *, min(case when idx then ctx_id end) over (partition by story) as stop from a)
    select ctx_id, story, stop is not null as completed from b where stop is null or ctx_id < stop"""
)
def until_index(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each story up to its first index page, which completes it."""
    rows = table(spark, d, "pipeline_contexts").where("url is not null").select("ctx_id", "url", F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*/[^/?#]*/[^/?#]*", 0).alias("story"))
    return learning.until_index(rows, "story", "ctx_id", U.page_type(F.col("url")) == "index").select("ctx_id", "story", "completed")


_KNOWN = f"(select domain, {_strip('lower(k)')} as keyword from (select domain, unnest(ads_keywords_learned) as k from site_profiles) where {_is_keyword(_strip('lower(k)'))})"


@query(
    f"""with {_EDGES}, f as (select k.* from k where n >= 5 and not exists (select 1 from {_KNOWN} w where w.domain = k.domain and w.keyword = k.line)),
    r as (select *, row_number() over (partition by domain order by n desc, line) as rank from f) select domain, line, n, rank from r where rank <= 20"""
)
def new_suspects(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "site_profiles").select("domain", F.explode("ads_keywords_learned").alias("k")).select("domain", X.strip(F.lower("k")).alias("keyword")).where(X.is_keyword(F.col("keyword")))
    docs = table(spark, d, "documents", spread=True)
    return learning.new_suspects(docs, F.coalesce("source", F.lit("")), F.col("text"), known).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""with a as (select ctx_id, html, regexp_replace(html, '(?is)<(script|style|noscript)\\b.*?</(?:script|style|noscript)\\s*>', '', 'g') as bare from pipeline_contexts where html is not null)
    select ctx_id, md5(case when length(html) <= 900 then html when length(bare) <= 900 then bare
      else {_strip("regexp_replace(regexp_replace(bare, '(?s)<[^>]*>', chr(10), 'g'), '[ \\t\\x{b}\\f\\r\\n]*\\n[ \\t\\x{b}\\f\\r\\n]*', chr(10), 'g')")}[1:900] end) as snippet from a"""
)
def snippets(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "pipeline_contexts").where("html is not null")
    return df.select("ctx_id", F.md5(learning.snippet(F.col("html"), 900)).alias("snippet"))
