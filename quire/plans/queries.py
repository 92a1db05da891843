"""Core queries over whole tables, each with the SQL that states the same result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.functions import urls as U
from quire.operators import boilerplate, chapters, fetching, guards, lines, naming, profiles, render
from quire.operators.shared import materialize
from quire.plans import chapters as job
from quire.sources.tables import table

_REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _REGISTRY[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


# ---- SQL fragments ----------------------------------------------------------------------------------------------------

_BREAKS = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
_BLANKS = r"[\t\n\x{b}\x{c}\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_BLANKS}+|{_BLANKS}+$', '', 'g')"


def _lines(c: str) -> str:
    parts = f"regexp_split_to_array({c}, '{_BREAKS}')"
    return f"(case when {parts}[-1] = '' then {parts}[1:len({parts})-1] else {parts} end)"


def _site(c: str) -> str:
    host = rf"lower(regexp_extract({c}, '(?i)^\s*[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#\s]+)', 1))"
    return f"regexp_replace({host}, '^(?:www|m)\\.', '')"


def _path(c: str) -> str:
    return rf"regexp_extract({c}, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)', 1)"


def _segments(c: str) -> str:
    return f"list_filter(string_split({_path(c)}, '/'), lambda x: x <> '')"


def _list(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


# ---- pages ------------------------------------------------------------------------------------------------------------


@query()
def chapters_clean(spark: SparkSession, d: str) -> DataFrame:
    return job.chapters(spark, d)


_REGISTRY["chapters"] = _REGISTRY.pop("chapters_clean")


@query()
def pages_extracted(spark: SparkSession, d: str) -> DataFrame:
    return job.extracted(spark, d)


_JUNK = " or ".join(f"regexp_matches(html[1:2000], '(?i)<title>[^<]*{t}[^<]*</title>')" for t in X.JUNK_TITLES)
_CHALLENGE = " or ".join(f"regexp_matches(html[1:5000], '(?i){p}')" for p in X.CHALLENGE)


@query(
    f"""select ctx_id,
      case when html is null or length({_strip("html")}) < 200 then true when coalesce(status_code, 200) in {tuple(X.JUNK_STATUS)} then true else ({_JUNK}) end as junk,
      case when html is null or length(html) < 100 then false else ({_CHALLENGE}) end as challenge,
      case when status_code = 429 then 'retry' when html is null then 'missing' else 'page' end as fetch
    from pipeline_contexts"""
)
def page_checks(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "pipeline_contexts")
    fetch = F.when(F.col("status_code") == 429, "retry").when(F.col("html").isNull(), "missing").otherwise("page")
    return df.select("ctx_id", X.is_junk_page(F.col("html"), F.col("status_code")).alias("junk"), X.is_challenge(F.col("html")).alias("challenge"), fetch.alias("fetch"))


@query(
    f"""select ctx_id, length({_strip("coalesce(content, '')")}) >= 100 as valid,
      least(1.0::double, length({_strip("coalesce(content, '')")}) / 2000.0::double) as score from pipeline_contexts"""
)
def length_scores(spark: SparkSession, d: str) -> DataFrame:
    s = X.length_score(F.col("content"))
    return table(spark, d, "pipeline_contexts").select("ctx_id", s["valid"].alias("valid"), s["score"].alias("score"))


@query(
    f"""with a as (select doc_id, {_strip("text")} as t from documents),
    b as (select doc_id, t, regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+') as w,
        len(list_filter(regexp_split_to_array(t, '[.!?。！？]+'), lambda x: length({_strip("x")}) > 0)) as s,
        list_filter({_lines("t")}, lambda x: length({_strip("x")}) > 0) as r, (length(t) - length(replace(t, chr(10) || chr(10), ''))) / 2.0::double as g from a),
    c as (select doc_id, len(w) as n, len(list_distinct(list_transform(w, lambda x: lower(x)))) as kinds, s, g, len(r) as m,
        len(list_filter(r, lambda x: regexp_matches(x, '^(?:[A-Z]|[^\\p{{L}}\\p{{N}}_]|\\p{{Nd}}){{5,}}$'))) as caps from b)
    select doc_id, round((
        (case when n < 20 then n / 20.0::double * 0.5::double else least(1.0::double, n / 200.0::double) end)
      + (case when s = 0 then 0.3::double when n / s::double < 5 then n / s::double / 5 when n / s::double <= 50 then 1.0::double
              else greatest(0.3::double, 1.0::double - (n / s::double - 50) / 100) end)
      + least(1.0::double, (g + 1) / greatest(m / 3.0::double, 1.0::double))
      + greatest(0.0::double, 1.0::double - caps / greatest(m, 1)::double * 3)
      + (case when n = 0 then 0.0::double else least(1.0::double, kinds / n::double * 1.5::double) end)) / 5, 3) as score from c"""
)
def prose_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", spread=True).select("doc_id", X.prose_score(F.col("text")).alias("score"))


# ---- addresses and titles ---------------------------------------------------------------------------------------------

_SLUG_SQL = U.SLUG
_S = _segments("url")
_FIRST = f"list_min(list_filter(list_transform({_S}, lambda x, i: case when i > 1 and regexp_matches(x, '^\\d+(?:-|$)') then i end), lambda x: x is not null))"


@query(
    f"""with p as (select ctx_id, url, {_S} as s, {_FIRST} as f from pipeline_contexts)
    select ctx_id, {_site("url")} as site,
      case when regexp_extract(url, '{_SLUG_SQL}', 2) <> '' then regexp_extract(url, '{_SLUG_SQL}', 1) || (regexp_extract(url, '{_SLUG_SQL}', 2)::hugeint + 1)::varchar || regexp_extract(url, '{_SLUG_SQL}', 3) end as next_slug,
      case when regexp_extract(url, '(/s/\\d+/)(\\d+)(/.+)?$', 2) <> '' then regexp_replace(url, '(/s/\\d+/)(\\d+)(/.+)?$', '') || regexp_extract(url, '(/s/\\d+/)(\\d+)(/.+)?$', 1)
        || (regexp_extract(url, '(/s/\\d+/)(\\d+)(/.+)?$', 2)::hugeint + 1)::varchar || regexp_extract(url, '(/s/\\d+/)(\\d+)(/.+)?$', 3) end as next_story,
      case when regexp_matches(url, '{U.CHAPTER}') then 'chapter' when regexp_matches({_path("url")}, '{U.INDEX}') then 'index' else 'other' end as page_type,
      case when len(s) >= 3 and s[1] = 's' and regexp_matches(s[2], '^\\d+$') then '/s/' || s[2] || '/'
           when f is not null then case when regexp_matches(s[f], '^\\d+-') then '/' || array_to_string(s[1:f-1], '/') || '/' || regexp_extract(s[f], '^(\\d+)-', 1)
             else '/' || array_to_string(s[1:f-1], '/') || '/' || s[f] || '/' end end as story_prefix,
      array_to_string(list_concat([{_site("url")}], s[1:2]), '/') as output_dir,
      coalesce(regexp_matches(url, '(?i)^https?://[^/?#]+'), false) as valid
    from p"""
)
def addresses(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pipeline_contexts").select(
        "ctx_id", U.site_key(u).alias("site"), U.next_by_slug(u).alias("next_slug"), U.next_by_story(u).alias("next_story"), U.page_type(u).alias("page_type"),
        U.story_prefix(u).alias("story_prefix"), U.output_dir(u).alias("output_dir"), U.is_valid(u).alias("valid"),
    )


def _normal(c: str) -> str:
    plain = rf"regexp_replace(coalesce({c}, ''), '[\x00-\x1f\x7f]', '', 'g')"
    return _strip(rf"regexp_replace({_strip(rf"regexp_replace({plain}, '[ \t]+', ' ', 'g')")}, '[\-–—]+\s*$', '', 'g')")


def _suffix(c: str) -> str:
    c = _strip(rf"regexp_replace({c}, '(?i)\s*[\|–—\-]\s*(?:{'|'.join(X.SITES)})\s*$', '', 'g')")
    c = _strip(rf"regexp_replace({c}, '(?i),\s*a\s+.{{3,80}}?\s+fanfic(?:tion)?\s*$', '', 'g')")
    return _strip(rf"regexp_replace({c}, '(?i)\s*\[\s*[\d,.\s]*\.?\s*words?\s*\]\s*$', '', 'g')")


_KEPT = rf"""list_filter(list_transform(regexp_split_to_array(title_raw, '\s*[\|–—]\s*'), lambda x: {_strip("x")}), lambda p: length(p) >= 3
    and not regexp_matches(p, '(?i)^\s*(?:chapter|chap|ch|episode|ep|part|chuong|phan)(?:[^\p{{L}}\p{{N}}_]|$)') and lower(p) not in {_list(X.KNOWN_SITES)})"""


@query(
    f"""with a as (select ctx_id, title_raw, {_normal("title_raw")} as n, {_KEPT} as k from pipeline_contexts)
    select ctx_id, n as normal, case when title_raw is null then null when regexp_matches(title_raw, '[|–—]') then {_suffix("n")} else n end as title,
      list_filter(k, lambda p: length(p) = list_max(list_transform(k, lambda q: length(q))))[1] as story from a"""
)
def titles(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title_raw")
    return table(spark, d, "pipeline_contexts").select(
        "ctx_id", X.normalize_title(t).alias("normal"), F.when(t.isNotNull(), X.tag_title(t)).alias("title"), X.story_title(t).alias("story")
    )


@query()
def chapter_files(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents")
    return df.select("doc_id", naming.chapter_file(F.col("chapter_index"), F.col("title")).alias("file"))


# ---- boilerplate ------------------------------------------------------------------------------------------------------


def _is_keyword(c: str) -> str:
    words = f"len(list_filter(regexp_split_to_array({c}, '{_BLANKS}+'), lambda w: w <> ''))"
    nav = r"(?i)^(?:(?:next|prev(?:ious)?)\s+(?:chapter|page)|(?:fiction|chapter)\s+index)\s*$"
    return (
        f"(not starts_with({c}, '<') and not starts_with({c}, '#') and not contains({c}, '</') and not contains({c}, '://') and length({c}) between 8 and 200 "
        f"and lower({c}) not in {_list(X.GENERIC)} and {words} <= 10 and not regexp_matches({c}, '{nav}'))"
    )


_FILLED = f"list_filter(list_transform({_lines('text')}, lambda x: {_strip('x')}), lambda x: x <> '')"
_EDGES = f"""e as (select coalesce(source, '') as domain, lower(unnest(list_concat(f[1:5], f[greatest(len(f) - 4, 1):greatest(len(f) - 4, 1) + 4]))) as line
    from (select source, {_FILLED} as f from documents)),
  k as (select domain, line, count(*) as n from e where length(line) between 10 and 300 and {_is_keyword("line")} group by all)"""


@query(f"with {_EDGES} select domain, line, n from k")
def edge_suspects(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.suspects(table(spark, d, "documents", spread=True), F.coalesce("source", F.lit("")), F.col("text"))


@query(
    f"""with {_EDGES}, r as (select *, row_number() over (partition by domain order by n desc, line) as rank from k where n >= 3)
    select domain, line, n, rank, case when n >= 10 then 'auto' else 'review' end as kind from r where rank <= 20"""
)
def edge_candidates(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.candidates(edge_suspects(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""with {_EDGES}, r as (select *, row_number() over (partition by domain order by n desc, line) as rank from k where n >= 3),
    w as (select domain, list(line) as ws from r where rank <= 20 and n >= 10 group by domain),
    j as (select doc_id, text, {_lines("text")} as ls, ws from documents left join w on coalesce(source, '') = w.domain)
    select doc_id, md5(case when ws is null then text else array_to_string(list_filter(ls, lambda x: {_strip("x")} = '' or len(list_filter(ws, lambda k: contains(lower(x), k))) = 0), chr(10)) end) as clean from j"""
)
def boilerplate_removed(spark: SparkSession, d: str) -> DataFrame:
    words = edge_candidates(spark, d).where("kind = 'auto'").select("domain", F.col("line").alias("keyword"))
    docs = table(spark, d, "documents", spread=True).select("doc_id", "source", "text")
    return boilerplate.filter_lines(docs, F.coalesce("source", F.lit("")), "text", words).select("doc_id", F.md5("text").alias("clean"))


@query(
    f"""select domain, list_sort(list(distinct {_strip("lower(k)")})) as keywords from (select domain, unnest(ads_keywords_learned) as k from site_profiles)
    where {_is_keyword(_strip("k"))} group by domain"""
)
def profile_keywords(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "site_profiles").select("domain", F.explode("ads_keywords_learned").alias("k")).where(X.is_keyword(F.col("k")))
    return own.groupBy("domain").agg(F.array_sort(F.collect_set(X.strip(F.lower("k")))).alias("keywords"))


# ---- duplicates and guards --------------------------------------------------------------------------------------------

_FP = f"md5(regexp_replace({_strip('text')}, '{_BLANKS}+', ' ', 'g'))[1:16]"


@query(f"select doc_id, fp, row_number() over (partition by fp order by doc_id) as copy_no from (select doc_id, {_FP} as fp from documents where text is not null)")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", spread=True).where("text is not null")
    prints = materialize(docs.select("doc_id", X.fingerprint(F.col("text")).alias("fp")), "prints")
    rows = guards.copies(prints, ["doc_id"], bucket=F.floor(F.col("doc_id") / 10_000))
    return rows.select("doc_id", "fp", F.col("copy_no").cast("long").alias("copy_no"))


@query(
    f"""with a as (select story_id, doc_id, {_FP} as fp from documents where text is not null and story_id is not null),
    b as (select *, case when row_number() over (partition by story_id, fp order by doc_id) > 1 then doc_id end as again from a),
    c as (select *, min(again) over (partition by story_id) as stop from b)
    select story_id, doc_id, fp from c where stop is null or doc_id < stop"""
)
def until_repeat(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null and story_id is not null").select("story_id", "doc_id", X.fingerprint(F.col("text")).alias("fp"))
    return guards.until_repeat(docs, "story_id", "doc_id", "fp")


_STEPS = "(select distinct result_id, ctx_id, domain, block_type, block_name, status, method_used, confidence, char_count, recorded_at from block_results)"


@query(
    f"""with r as (select *, row_number() over (partition by ctx_id, block_type order by case when status in ('success', 'fallback') then 0 else 1 end,
        case when status in ('success', 'fallback') then result_id end nulls first, result_id desc) as k from {_STEPS})
    select ctx_id, block_type, result_id, block_name, status, method_used, confidence from r where k = 1"""
)
def chain_results(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "block_results").dropDuplicates(["result_id", "ctx_id", "block_type", "block_name", "status", "method_used", "confidence"])
    out = guards.first_success(steps, ["ctx_id", "block_type"], ["result_id"])
    return out.select("ctx_id", "block_type", "result_id", "block_name", "status", "method_used", "confidence")


@query(
    f"""with a as (select result_id, domain, recorded_at, case when status = 'failed' then 1 else 0 end as f from {_STEPS}),
    b as (select *, sum(1 - f) over (partition by domain order by recorded_at, result_id rows unbounded preceding) as g from a)
    select result_id, domain, cast(sum(f) over (partition by domain, g order by recorded_at, result_id rows unbounded preceding) as bigint) as streak from b"""
)
def failure_streaks(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "block_results").select("result_id", "domain", "recorded_at", "status").distinct()
    return guards.streaks(steps, "domain", ["recorded_at", "result_id"], F.coalesce(F.col("status") == "failed", F.lit(False)), F.date_trunc("day", "recorded_at")).select("result_id", "domain", "streak")


@query(
    """select event_id, user_id, count(*) over (partition by user_id order by epoch_us(ts) range between 59999999 preceding and current row) as recent from events"""
)
def trailing_minute(spark: SparkSession, d: str) -> DataFrame:
    return guards.trailing_count(table(spark, d, "events"), "user_id", "ts").select("event_id", "user_id", "recent")


@query(
    f"""with b as (select ctx_id, sum(duration_ms) as ms, avg(case when status in ('success', 'fallback') and confidence > 0 then confidence end) as conf from
        (select distinct result_id, ctx_id, status, confidence, duration_ms from block_results) group by ctx_id),
    a as (select c.ctx_id, coalesce(validation_score, 0.0) as q, least(1.0::double, greatest(0.0::double, 1.0::double - (greatest(coalesce(ms, 0.0), 1.0) - 500) / 4500)) as sp,
      case when contains(lower(coalesce(fetch_method, '')), 'playwright') then 0.5::double else 1.0::double end as r, coalesce(conf, 0.0) as co from pipeline_contexts c left join b using (ctx_id))
    select ctx_id, cast(floor(sp * 1000 + 0.5000001) as bigint) as speed, cast(floor((q * 0.4::double + sp * 0.3::double + r * 0.2::double + co * 0.1::double) * 1000 + 0.5000001) as bigint) as total from a"""
)
def run_scores(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "block_results").select("result_id", "ctx_id", "status", "confidence", "duration_ms").distinct()
    good = F.when(F.col("status").isin("success", "fallback") & (F.col("confidence") > 0), F.col("confidence"))
    sums = steps.groupBy("ctx_id").agg(F.sum("duration_ms").alias("ms"), F.avg(good).alias("conf"))
    c = table(spark, d, "pipeline_contexts").select("ctx_id", "validation_score", "fetch_method").join(sums, "ctx_id", "left")
    score = fetching.pipeline_score(F.col("validation_score"), F.col("ms"), F.col("fetch_method"), F.col("conf"), None)
    return c.select("ctx_id", *(F.floor(score[k] * 1000 + 0.5000001).alias(k) for k in ("speed", "total")))  # thousandths


@query(
    f"""with f as (select url, status_code, html, content, title_clean, ({_CHALLENGE}) and length(html) >= 100 as ch from pipeline_contexts),
    u as (select 'rate_limited' as type from f where status_code = 429 union all select 'blocked' from f where ch union all select 'missing_page' from f where html is null
      union all select 'short_content' from f where content is not null and length(trim(content)) < 100 union all select 'bare_title' from f where regexp_matches(title_clean, '^Chapter \\d+$'))
    select type, count(*) as n from u group by type"""
)
def issue_counts(spark: SparkSession, d: str) -> DataFrame:
    return fetching.issues(table(spark, d, "pipeline_contexts")).groupBy("type").agg(F.count("*").alias("n"))


@query(f"select domain, block_type, status, count(*) as n, cast(sum(char_count) as bigint) as chars from {_STEPS} group by all")
def step_totals(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "block_results").select("result_id", "ctx_id", "domain", "block_type", "block_name", "status", "method_used", "confidence", "char_count", "recorded_at").distinct()
    return steps.groupBy("domain", "block_type", "status").agg(F.count("*").alias("n"), F.sum("char_count").alias("chars"))


# ---- chapters and books -----------------------------------------------------------------------------------------------

_ROWS = f"list_transform({_lines('text')}, lambda x: {_strip('x')})"
_SCORES = ", ".join(f"len(list_filter(r[1:100], lambda x: regexp_matches(x, '{p}'))) as s{k}" for k, (_, _, p) in enumerate(chapters.CASES))
_BEST = "greatest(s0, s1, s2, s3)"
_PICK = "case " + " ".join(f"when s{k} = {_BEST} then '{i}'" for k, (i, _, _) in enumerate(chapters.CASES)) + " end"
_PICK_P = "case " + " ".join(f"when s{k} = {_BEST} then '{p}'" for k, (_, _, p) in enumerate(chapters.CASES)) + " end"
_CASE = f"c as (select doc_id, ls, {_BEST} as score, {_PICK} as id, {_PICK_P} as pattern from (select doc_id, r as ls, {_SCORES} from (select doc_id, {_ROWS} as r from documents)) where {_BEST} > 0)"


@query(f"with {_CASE} select doc_id, id as case_id, cast(score as integer) as score from c")
def boundary_cases(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents", spread=True).select("doc_id", chapters.best_case(F.col("text")).alias("c")).where("c is not null")
    return df.select("doc_id", F.col("c.id").alias("case_id"), F.col("c.score").alias("score"))


_CUTS = " ".join(
    f"when '{i}' then list_filter(list_transform(ls, lambda x, i: case when regexp_matches(x, '{p}') then i end), lambda x: x is not null)" for i, _, p in chapters.CASES
)


@query(
    f"""with {_CASE}, a as (select doc_id, ls, case id {_CUTS} end as cuts from c), b as (select doc_id, ls, cuts, unnest(range(1, len(cuts) + 1)) as k from a)
    select doc_id, cast(k as integer) as chapter_index, ls[cuts[k]] as title from b"""
)
def text_chapters(spark: SparkSession, d: str) -> DataFrame:
    return chapters.split_chapters(table(spark, d, "documents", spread=True), "doc_id", "text").select(F.col("id").alias("doc_id"), "chapter_index", "title")


def _holds(c: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower(coalesce({c}, '')), '{w}')" for w in words) + ")"


_SPINE = "select source_path as book, chapter_index as pos, raw_id as doc_id, source_path as file, metadata['toc_title'] as toc_title from raw_documents where ends_with(source_path, '.epub')"


@query(
    f"""with s as ({_SPINE}), k as (select *, case when {_holds("file", chapters.SKIP_FILES)} or {_holds("toc_title", chapters.SKIP)} then 'skip'
        when {_holds("file", chapters.MATTER_FILES)} or {_holds("toc_title", chapters.FRONT + chapters.BACK)} then 'matter' when toc_title is not null then 'start' else 'open' end as kind from s),
    m as (select *, last_value(case when kind <> 'open' then kind end ignore nulls) over w as event, sum(case when kind = 'start' then 1 else 0 end) over w as number
        from k window w as (partition by book order by pos, doc_id rows between unbounded preceding and current row)),
    n as (select *, case when kind = 'start' or (kind = 'open' and event = 'start') then number else 0 end as chapter_index from m where kind <> 'skip')
    select book, cast(chapter_index as bigint) as chapter_index, case when chapter_index = 0 then 'matter' else 'chapter' end as kind, cast(count(*) as bigint) as documents, min(doc_id) as first_doc from n group by book, chapter_index"""
)
def book_plans(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_documents").where("endswith(source_path, '.epub')")
    spine = raw.select(
        F.col("source_path").alias("book"), F.col("chapter_index").alias("pos"), F.col("raw_id").alias("doc_id"), F.col("source_path").alias("file"),
        F.col("metadata")["toc_title"].alias("toc_title"),
    )
    plan = chapters.chapter_plan(spine)
    return plan.select("book", F.col("chapter_index").cast("long"), "kind", F.size("doc_ids").cast("long").alias("documents"), F.array_min("doc_ids").alias("first_doc"))


@query(
    """with f as (select story_id, doc_id, printf('%04d_', chapter_index) || doc_id || '.md' as file from documents where story_id is not null and chapter_index is not null)
    select story_id, doc_id, file, lag(file) over (partition by story_id order by file) as prev_file, lead(file) over (partition by story_id order by file) as next_file from f"""
)
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("story_id is not null and chapter_index is not null")
    files = docs.select("story_id", "doc_id", F.concat(F.format_string("%04d_", "chapter_index"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"))
    return render.with_neighbours(files, "story_id", "file").select("story_id", "doc_id", "file", "prev_file", "next_file")


@query(
    """with f as (select story_id, printf('%04d_', chapter_index) || doc_id || '.md' as file, title, added_at from documents where story_id is not null and chapter_index is not null),
    g as (select story_id, list(struct_pack(f := file, t := coalesce(title, file)) order by file) as fs, max(added_at) as added from f group by story_id)
    select story_id, md5(concat_ws(chr(10), '# ' || 'Story ' || story_id || chr(10), '> [!abstract] Story Info', '> - **Chapters**: ' || len(fs),
      case when added is not null then '> - **Last updated**: ' || strftime(added, '%Y-%m-%d') end, '', '## Chapters', '',
      array_to_string(list_transform(fs, lambda x, i: i || '. [' || replace(x.t, ']', chr(92) || ']') || '](' || x.f || ')'), chr(10)), '')) as content from g"""
)
def story_indexes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("story_id is not null and chapter_index is not null")
    files = docs.select(
        "story_id", "title", "added_at", F.concat(F.lit("Story "), F.col("story_id").cast("string")).alias("name"),
        F.concat(F.format_string("%04d_", "chapter_index"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"),
    )
    return render.indexes(files, "story_id", "name", "file", "title", F.col("added_at")).select("story_id", F.md5("content").alias("content"))


def _mode(mode: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        c = F.col
        out = render.rendered(mode, c("title"), c("chapter_index"), c("text"), F.lit(None).cast("string"), c("source"))
        return table(spark, d, "documents", spread=True).select("doc_id", out.alias("content"))

    run.__name__ = f"render_{mode}"
    return run


for _m in render.MODES:
    if _m != "obsidian":  # with its SQL in plans/stores.py
        query()(_mode(_m))


# ---- cleaning ---------------------------------------------------------------------------------------------------------


def _floor(c: str) -> str:
    return f"md5(case when length({_strip(c)}) >= {lines.LEAST} then {c} else content end)"


def _matches(c: str, patterns: list[str]) -> str:
    return "(" + " or ".join(f"regexp_matches({c}, '(?i){p}')" for p in patterns) + ")"


_JOINED = "array_to_string(ls, chr(10))"
_WORDS = f"len(list_filter(regexp_split_to_array(x, '{_BLANKS}+'), lambda w: w <> ''))"
_COMMENT_TAPE = f"array_to_string(list_transform(bare, lambda x: case when {_matches('x', lines.COMMENT_MARKS)} then 'C' when {_WORDS} >= {lines.PROSE} then 'p' else 'o' end), '')"
_POSTFIX_TAPE = f"array_to_string(list_transform(bare, lambda x: case when lower(x) in {_list(lines.NAV_WORDS)} then 'N' when {_matches('x', lines.POSTFIX_MARKS)} then 'H' else 'o' end), '')"
_FACT_TAPE = f"""array_to_string(list_transform(bare[1:25], lambda x: case when x <> '' and {_matches('x', lines.META)} then 'F'
  when (starts_with(x, '-') and length(x) <= 100) or (length(x) between 1 and 8 and regexp_matches(x, '{lines.DIGITS_AND_SIGNS}')) then 'c' when {_WORDS} >= {lines.PROSE} then 'p' else 'o' end), '')"""


def _head(tape: str, start: str, here: str) -> str:
    """The lines before the first place, from `start` on, where `here` holds of the tape and enough text stands before."""
    heads = f"list_transform(list_filter(range({start}, len(ls)), lambda i: {here}), lambda i: array_to_string(ls[1:i], chr(10)))"
    return f"coalesce(list_filter({heads}, lambda h: length({_strip('h')}) >= {lines.LEAST})[1], content)".replace("TAPE", tape)


@query(
    f"""with a as (select ctx_id, content, {_lines("content")} as ls from pipeline_contexts where content is not null),
    b as (select *, list_transform(ls, lambda x: {_strip("x")}) as bare from a),
    t as (select *, {_COMMENT_TAPE} as ct, {_POSTFIX_TAPE} as pt, length(regexp_extract({_FACT_TAPE}, '^[^F]*F[Fco]*')) as facts from b),
    c as (select ctx_id, content,
      array_to_string(list_filter(ls, lambda x: not regexp_matches(x, '(?i){lines.SCRIPT_LINE}')), chr(10)) as s,
      array_to_string(list_filter(ls, lambda x: not {_matches(_strip("x"), lines.INTERFACE)}), chr(10)) as u,
      {_head("ct", "greatest(5, cast(floor(len(ls) * 0.30::double) as bigint))", "TAPE[i + 1] = 'C' and length(replace(replace(TAPE[i + 2:i + 7], 'C', ''), 'o', '')) <= 1")} as k,
      {_head("pt", "greatest(3, cast(floor(len(ls) * 0.35::double) as bigint))", "TAPE[i + 1] = 'H' or length(replace(replace(TAPE[i + 1:i + 5], 'H', ''), 'o', '')) >= 3")} as p,
      array_to_string(ls[facts + 1 + coalesce(list_position(list_transform(bare[facts + 1:], lambda x: x <> ''), true), len(ls) - facts + 1) - 1:], chr(10)) as h, facts from t)
    select ctx_id, {_floor("s")} as no_scripts, {_floor("u")} as no_interface, md5(k) as no_comments, md5(p) as no_postfix,
      case when facts < 3 then md5(content) else {_floor("h")} end as no_header,
      md5(regexp_replace(content, '\\*\\*([^*\\n]+?)[ \\t]+\\*\\*', '**\\1** ', 'g')) as bold from c"""
)
def line_passes(spark: SparkSession, d: str) -> DataFrame:
    """Each pass of `cleaned` that SQL can state, by itself."""
    df = table(spark, d, "pipeline_contexts", spread=True).where("content is not null").select("ctx_id", "content")
    steps = {
        "no_scripts": lines.without_scripts, "no_interface": lines.without_interface, "no_comments": lines.without_comments,
        "no_postfix": lines.without_postfix, "no_header": lines.without_header, "bold": lines.fixed_bold,
    }
    return lines.passes(df, "content", steps).select("ctx_id", *(F.md5(n).alias(n) for n in steps))


@query()
def cleaned(spark: SparkSession, d: str) -> DataFrame:
    """All cleaning passes, then the trimmed edges."""
    df = table(spark, d, "pipeline_contexts", spread=True).select("ctx_id", "content")
    return lines.clean_content(df, "content", "clean", edges=True).select("ctx_id", "clean")


# ---- profiles ---------------------------------------------------------------------------------------------------------

_NOW = "2025-01-01 00:00:00"


@query(
    f"""select c.ctx_id, p.domain is not null as known, p.content_selector, p.nav_type,
      coalesce(floor((epoch_us(timestamp '{_NOW}') - epoch_us(p.last_learned)) / 86400000000) < 30, false) as fresh
    from pipeline_contexts c left join site_profiles p on {_site("c.url")} = p.domain"""
)
def profile_lookup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "pipeline_contexts").select("ctx_id", "url")
    p = table(spark, d, "site_profiles").withColumn("found", F.col("domain"))
    out = profiles.with_profile(docs, U.site_key(F.col("url")), p, ["found", "content_selector", "nav_type", "last_learned"])
    fresh = profiles.is_fresh(F.col("last_learned"), F.lit(_NOW).cast("timestamp"))
    return out.select("ctx_id", F.col("found").isNotNull().alias("known"), "content_selector", "nav_type", fresh.alias("fresh"))


_TWO = "(select domain, lead(content_selector) over (order by domain) as content_selector, lead(next_selector) over (order by domain) as next_selector, lead(confidence) over (order by domain) as confidence from site_profiles)"


@query(
    f"""with j as (select a.domain, {", ".join(f"a.{f} as a_{f}, b.{f} as b_{f}" for f in ("content_selector", "next_selector", "confidence"))} from site_profiles a join {_TWO} b using (domain))
    select domain, {", ".join(f'''case when coalesce(a_{f}, '') = coalesce(b_{f}, '') then a_{f} when coalesce(a_{f}, '') = '' then b_{f} when coalesce(b_{f}, '') = '' then a_{f}
      when coalesce(a_confidence, 0.5) >= coalesce(b_confidence, 0.5) then a_{f} else b_{f} end as {f}''' for f in ("content_selector", "next_selector"))} from j"""
)
def profiles_reconciled(spark: SparkSession, d: str) -> DataFrame:
    """Each site's selectors against a second opinion (here the next site's): agreement, gaps and conflicts all occur."""
    one = table(spark, d, "site_profiles").select("domain", "content_selector", "next_selector", "confidence", "remove_selectors", "requires_playwright")
    by = Window.partitionBy(F.lit(0)).orderBy("domain")  # the table is fixed at a few dozen rows
    two = one.select("domain", *(F.lead(c).over(by).alias(c) for c in one.columns[1:]))
    return profiles.reconcile(one, two, "domain", ["content_selector", "next_selector"]).select("domain", "content_selector", "next_selector")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quire.plans import stores  # noqa: F401  registers its queries

    return dict(_REGISTRY)


def oracle_sql() -> dict[str, str]:
    from quire.plans import stores  # noqa: F401

    return dict(_SQL)
