"""Registered queries of the core operators over the tables of a data folder, with SQL to compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.render import json_lines
from ..operators import extract, index, markdown, overview, search
from ..sources.artifacts import evicted
from ..sources.tables import table

QUERY = "shared buffer reader returns the stable index"


def _symbols(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "symbols").dropDuplicates(["symbol_id"])


def _sections(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "doc_sections").dropDuplicates(["section_id"])


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols under even numbers, sections under odd ones."""
    code = index.code_documents(_symbols(spark, folder).withColumn("doc_id", F.col("symbol_id") * 2))
    docs = index.doc_documents(_sections(spark, folder).withColumn("doc_id", F.col("section_id") * 2 + 1))
    return code.unionByName(docs)


def _index(spark: SparkSession, folder: str, stemming: bool = False, stored: bool = True) -> index.Index:
    return index.build(_documents(spark, folder), stemming, stored)


def text_terms(spark: SparkSession, folder: str) -> DataFrame:
    one = _sections(spark, folder).select("section_id", F.explode(X.text_tokens("content")).alias("term"))
    return one.groupBy("section_id", "term").agg(F.count("*").alias("tf"))


def identifier_parts(spark: SparkSession, folder: str) -> DataFrame:
    return _symbols(spark, folder).select("symbol_id", F.array_join(X.identifier_tokens("name"), " ").alias("parts"))


def index_postings(spark: SparkSession, folder: str) -> DataFrame:
    p = _index(spark, folder, stored=False).postings
    return p.select("term", "doc_id", F.col("field_id").cast("int").alias("field_id"), F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"))


def index_doc_freqs(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder, stored=False).doc_freqs


def index_field_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder, stored=False).field_stats.select(F.col("field_id").cast("int").alias("field_id"), "total_length", "doc_count")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round(F.col("score").cast("double"), 3))


def search_one(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(search.search(_index(spark, folder), QUERY, 20, stemming=False)).select("doc_id", "doc_type", "filepath", "score")


def search_filtered(spark: SparkSession, folder: str) -> DataFrame:
    only = search.Filters.of(["core,./server/"], [".py,RS"], "Code")
    return _rounded(search.search(_index(spark, folder), QUERY, 20, only, stemming=False)).select("doc_id", "doc_type", "filepath", "score")


def search_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Every repository's name as a query, the best five documents of each."""
    queries = table(spark, folder, "repos").select(F.col("repo_id").alias("query_id"), F.translate("name", "-", " ").alias("query"))
    return _rounded(search.search_many(_index(spark, folder), queries, 5, stemming=False)).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


def search_titles(spark: SparkSession, folder: str) -> DataFrame:
    """The titles and names of every hundredth section and symbol as queries, the best five documents of each."""
    titles = _sections(spark, folder).where("section_id % 100 = 0 and section_title is not null").select((F.col("section_id") * 2 + 1).alias("query_id"), F.col("section_title").alias("query"))
    names = _symbols(spark, folder).where("symbol_id % 100 = 0").select((F.col("symbol_id") * 2).alias("query_id"), F.translate("name", "_", " ").alias("query"))
    return _rounded(search.search_many(_index(spark, folder), titles.unionByName(names), 5, stemming=False)).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


def search_stemmed(spark: SparkSession, folder: str) -> DataFrame:
    return json_lines(search.search(_index(spark, folder, True), QUERY, 20))


def search_stemmed_hits(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(search.search(_index(spark, folder, True), QUERY, 20)).select("doc_id", "doc_type", "filepath", "score")


def query_letters(spark: SparkSession, folder: str) -> DataFrame:
    """Texts as queries: those with letters outside ASCII, and the first five."""
    texts = table(spark, folder, "documents").dropDuplicates(["doc_id"]).where("text is not null").select("doc_id", F.array_join(X.invalid_query_letters("text"), "").alias("letters"))
    return texts.where("letters <> ''")


def path_functions(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "source_files", "file_id", "filepath").distinct()
    return files.select(
        "file_id", X.in_dir("filepath", "core").alias("in_core"), X.extension("filepath").alias("ext"), X.is_example_path("filepath").alias("is_example"), X.is_test_candidate(F.lit(""), "filepath").alias("is_test"),
        X.file_stem("filepath").alias("stem"), X.parent_dir("filepath").alias("dir"),
    )


def comment_summaries(spark: SparkSession, folder: str) -> DataFrame:
    rows = _symbols(spark, folder).where("comment is not null").select("symbol_id", X.comment_info(F.coalesce("comment.body_preview", "comment.summary_line"), F.col("comment.source")).alias("c"))
    return rows.where("c is not null").select("symbol_id", "c.summary_line", "c.body_preview", F.array_join("c.flags", ",").alias("flags"))


def surface_counts(spark: SparkSession, folder: str) -> DataFrame:
    s = _symbols(spark, folder)
    apis = overview.public_apis(s).select("repo_id", F.lit("api").alias("surface"))
    types = overview.public_types(s).select("repo_id", F.lit("type").alias("surface"))
    return apis.unionByName(types).groupBy("repo_id", "surface").agg(F.count("*").alias("n"))


def _reexports(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "reexports").dropDuplicates(["reexport_id"])


def _overview(spark: SparkSession, folder: str) -> overview.Overview:
    return overview.overview(_symbols(spark, folder), _reexports(spark, folder), "symbol_id", "reexport_id", "repo_id")


def test_links(spark: SparkSession, folder: str) -> DataFrame:
    """The three best tests of every API of the surface."""
    links = overview.cards(_symbols(spark, folder), _reexports(spark, folder), "symbol_id", "reexport_id", "repo_id")[1]
    return links.select("repo_id", F.col("id").alias("symbol_id"), F.col("rank").cast("long").alias("rank"), "test_id", F.array_join("reasons", ",").alias("reasons"), F.col("score").cast("double").alias("score"))


def test_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Per repository the six best tests of its surface, with what they are linked to."""
    tests = _overview(spark, folder).tests
    return tests.select("repo_id", F.col("rank").cast("long").alias("rank"), "test_ref", "test_path", "test_name", F.array_join("linked_symbols", " ").alias("linked_symbols"), F.array_join("reasons", ",").alias("reasons"), F.col("score").cast("double").alias("score"))


def test_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Every test that is linked to some card, with the number of cards."""
    tests = overview.test_totals(_overview(spark, folder).cards, "repo_id")
    return tests.withColumn("score", F.col("score").cast("double"))


def surface_all(spark: SparkSession, folder: str) -> DataFrame:
    """Every card of the surface, with its score and the number of its tests."""
    every = _overview(spark, folder).cards
    return every.select("repo_id", "surface", "ref", "kind", "signature", "publicness", "summary", F.array_join("flags", ",").alias("flags"), F.col("linked").cast("long").alias("linked"), "score", "fallback")


def surface_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Per repository its six best API cards and type cards."""
    return _overview(spark, folder).shown.select("repo_id", "surface", F.col("rank").cast("long").alias("rank"), "ref", "signature", "publicness", F.col("linked").cast("long").alias("linked"), "score")


def surface_hints(spark: SparkSession, folder: str) -> DataFrame:
    return _overview(spark, folder).hints.select("repo_id", F.col("rank").cast("long").alias("rank"), "action", "target", "label", "reason")


def surface_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return _overview(spark, folder).meta.select("repo_id", "publicness", "comments", "tests", F.array_join("notes", "; ").alias("notes"), "truncated")


def reexport_targets(spark: SparkSession, folder: str) -> DataFrame:
    return overview.resolved_reexports(_reexports(spark, folder), _symbols(spark, folder), "reexport_id", "symbol_id", "repo_id")


def extracted_symbols(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "source_files").select("repo_id", "filepath", "content")
    return extract.symbols(files, "repo_id").distinct()


def extracted_reexports(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "source_files").select("repo_id", "filepath", "content")
    return extract.reexports(files, "repo_id").distinct()


def parse_report(spark: SparkSession, folder: str) -> DataFrame:
    """What a scan of each repository reports: files by status."""
    files = table(spark, folder, "source_files").select("repo_id", "file_id", "filepath", "content")
    done = extract.parsed(files, "repo_id", "file_id").select("repo_id", "file_id", "status").distinct()
    return done.groupBy("repo_id", "status").agg(F.count("*").alias("files"))


def parse_problems(spark: SparkSession, folder: str) -> DataFrame:
    """The files that a scan reports as failed, unsupported or oversized."""
    files = table(spark, folder, "source_files").select("repo_id", "file_id", "filepath", "content")
    return extract.parsed(files, "repo_id", "file_id").where("status <> 'Ok'").select("repo_id", "file_id", "filepath", "status").distinct()


def report_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The stored scan reports per repository."""
    r = table(spark, folder, "parse_reports").dropDuplicates(["scan_id"])
    return r.groupBy("repo_id").agg(F.sum("parsed_count").alias("parsed"), F.sum(F.size("unsupported")).alias("unsupported"), F.sum(F.size("failed")).alias("failed"), F.sum(F.size("oversized")).alias("oversized"))


def markdown_sections(spark: SparkSession, folder: str) -> DataFrame:
    """The sections of Markdown files that are put together from the stored sections, cut again.

    A section without a title is put in without a heading, so its text becomes the Introduction
    or joins the section before it.
    """
    s = _sections(spark, folder)
    path = X.surface_path("filepath")
    head = F.concat(F.repeat(F.lit("#"), F.least(F.greatest(F.size("heading_hierarchy"), F.lit(1)), F.lit(6))), F.lit(" "), F.col("section_title"))
    parts = s.select("repo_id", path.alias("filepath"), F.struct("ordinal", "section_id", F.coalesce(F.concat(head, F.lit("\n"), F.coalesce("content", F.lit(""))), F.col("content")).alias("text")).alias("p"))
    files = parts.groupBy("repo_id", "filepath").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["text"]), "\n").alias("content"))
    return markdown.sections(files, "repo_id")


def markdown_table(spark: SparkSession, folder: str) -> DataFrame:
    """The same with its lists as text."""
    return markdown_sections(spark, folder).select(
        "repo_id", "filepath", F.col("ordinal").cast("long").alias("ordinal"), "section_title", F.array_join("heading_hierarchy", " / ").alias("headings"), "content", F.array_join("code_symbols", ",").alias("code_symbols"),
        F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"),
    )


def cache_eviction(spark: SparkSession, folder: str) -> DataFrame:
    """Per repository, the files beyond the newest 20 kB."""
    files = table(spark, folder, "source_files").groupBy("repo_id", "file_id").agg(F.max("size_bytes").alias("size"), F.max("committed_at").alias("touched_at"))
    named = files.select("repo_id", F.col("file_id").cast("string").alias("path"), "size", "touched_at")
    return evicted(named, 20_000, "repo_id").select("repo_id", "path", "size", F.col("kept_size").cast("long").alias("kept_size"))


QUERIES = {
    f.__name__: f
    for f in (
        text_terms, identifier_parts, index_postings, index_doc_freqs, index_field_stats, search_one, search_filtered, search_batch, search_titles, search_stemmed, search_stemmed_hits, query_letters, path_functions, comment_summaries, surface_counts,
        test_links, test_cards, test_totals, surface_all, surface_cards, surface_hints, surface_coverage, reexport_targets, extracted_symbols, extracted_reexports, parse_report, parse_problems, report_totals, markdown_sections, markdown_table, cache_eviction,
    )
}

# -- the same in SQL ---------------------------------------------------------------------


def _words(x: str) -> str:
    return rf"list_filter(list_transform(list_filter(regexp_split_to_array({x}, '[^\p{{L}}\p{{N}}_]'), lambda w: w <> '' and strlen(w) < 80), lambda w: lower(w)), lambda w: strlen(w) > 1)"


def _parts(x: str, least: int = 1) -> str:
    cut = rf"regexp_replace(regexp_replace({x}, '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1-\2', 'g'), '(\p{{Ll}})(\p{{Lu}})', '\1-\2', 'g')"
    return rf"list_filter(list_transform(regexp_split_to_array({cut}, '[_\-./]'), lambda w: lower(w)), lambda w: strlen(w) > {least})"


_PATH = "replace(filepath, '\\', '/')"
_STEM = f"replace(replace(split_part(regexp_extract({_PATH}, '[^/]*$'), '.', 1), '_test', ''), '_spec', '')"
_DIR = f"regexp_extract({_PATH}, '^(.*)/', 1)"
_TESTS = "/tests/|/test/|/__tests__/|/spec/|\\.test\\.|_test\\.|\\.spec\\.|_spec\\."
_SYM = "sym as (select distinct on (symbol_id) * from symbols)"
_SEC = "sec as (select distinct on (section_id) * from doc_sections)"
_SAID = "case when comment.body_preview is null or comment.body_preview = comment.summary_line then comment.summary_line else concat_ws(' ', comment.summary_line, comment.body_preview) end"
_FIELDS = f"""{_SYM}, {_SEC}, fields as (
select symbol_id * 2 as doc_id, 'Code' as doc_type, filepath, 0 as field_id, {_parts('name')} as toks from sym
union all select symbol_id * 2, 'Code', filepath, 1, coalesce({_words(f'({_SAID})')}, []) from sym
union all select symbol_id * 2, 'Code', filepath, 2, coalesce(flatten(list_transform(params, lambda p: {_parts('p')})), []) from sym
union all select symbol_id * 2, 'Code', filepath, 3, {_parts('filepath')} from sym
union all select section_id * 2 + 1, 'Doc', filepath, 0, list_concat(coalesce({_words('section_title')}, []), coalesce(flatten(list_transform(heading_hierarchy, lambda p: {_words('p')})), [])) from sec
union all select section_id * 2 + 1, 'Doc', filepath, 1, coalesce({_words('content')}, []) from sec
union all select section_id * 2 + 1, 'Doc', filepath, 2, coalesce(flatten(list_transform(code_symbols, lambda p: {_parts('p')})), []) from sec
union all select section_id * 2 + 1, 'Doc', filepath, 3, {_parts('filepath')} from sec),
terms as (select doc_id, field_id, least(len(toks), 65535) as dl, unnest(toks) as term from fields where toks is not null),
post as (select term, doc_id, field_id, dl, count(*) as tf from terms group by all),
freqs as (select term, count(distinct doc_id) as df from post group by term),
stats as (select field_id, sum(least(len(toks), 65535))::bigint as total_length, count(*) filter (len(toks) > 0) as doc_count from fields where toks is not null group by field_id),
total as (select count(distinct doc_id) as n from fields), docs as (select distinct doc_id, doc_type, filepath from fields)"""
_SCORED = f"""parts as (select q.query_id, p.doc_id, q.qpos, p.field_id,
  ((ln(1 + (n - df + 0.5::double) / (df + 0.5::double))::float * case when doc_count > 0 then ((tf::float * 2.2::float)::float / (1.2::float::double * (0.25::float + ((0.75::float * dl::float)::float / (total_length::float / doc_count::float)::float)::float)::float::double + tf::double)::float)::float else 0::float end)::float
   * [4.0, 2.0, 1.5, 1.0][p.field_id + 1]::float)::float as s
  from q join post p using (term) join freqs using (term) join stats using (field_id), total),
scored as (select query_id, doc_id, round(list_reduce(list_concat([0::float], list(s order by qpos, field_id)), lambda a, b: (a + b)::float)::double, 3) as score, list_reduce(list_concat([0::float], list(s order by qpos, field_id)), lambda a, b: (a + b)::float) as exact from parts group by query_id, doc_id)"""
_ONE = f"q as (select 0 as query_id, unnest({_words(repr(QUERY))}) as term, generate_subscripts({_words(repr(QUERY))}, 1) - 1 as qpos)"

SQL = {
    "text_terms": f"with {_SEC} select section_id, term, count(*) as tf from (select section_id, unnest({_words('content')}) as term from sec) group by all",
    "identifier_parts": f"with {_SYM} select symbol_id, array_to_string({_parts('name')}, ' ') as parts from sym",
    "index_postings": f"with {_FIELDS} select term, doc_id, field_id, tf, dl from post",
    "index_doc_freqs": f"with {_FIELDS} select term, df from freqs",
    "index_field_stats": f"with {_FIELDS} select field_id, total_length, doc_count from stats",
    "search_one": f"with {_FIELDS}, {_ONE}, {_SCORED} select doc_id, doc_type, filepath, score from scored join docs using (doc_id) order by exact desc, doc_id limit 20",
    "search_filtered": f"with {_FIELDS}, {_ONE}, {_SCORED} select doc_id, doc_type, filepath, score from scored join docs using (doc_id) where doc_type = 'Code' and (starts_with({_PATH}, 'core/') or starts_with({_PATH}, 'server/')) and lower(regexp_extract({_PATH}, '[^/]\\.([^./]+)$', 1)) in ('py', 'rs') order by exact desc, doc_id limit 20",
    "search_batch": f"with {_FIELDS}, q as (select repo_id as query_id, unnest({_words("replace(name, '-', ' ')")}) as term, generate_subscripts({_words("replace(name, '-', ' ')")}, 1) - 1 as qpos from repos), {_SCORED} select query_id, rank, doc_id, score from (select *, row_number() over (partition by query_id order by exact desc, doc_id) as rank from scored) where rank <= 5",
    "search_titles": f"""with {_FIELDS}, texts as (select section_id * 2 + 1 as query_id, section_title as query from sec where section_id % 100 = 0 union all select symbol_id * 2, replace(name, '_', ' ') from sym where symbol_id % 100 = 0),
q as (select query_id, unnest({_words('query')}) as term, generate_subscripts({_words('query')}, 1) - 1 as qpos from texts where query is not null), {_SCORED}
select query_id, rank, doc_id, score from (select *, row_number() over (partition by query_id order by exact desc, doc_id) as rank from scored) where rank <= 5""",
    "query_letters": "with t as (select distinct on (doc_id) doc_id, list_filter(string_split(text, ''), lambda x: regexp_matches(x, '\\p{L}') and not regexp_matches(x, '[\\x00-\\x7F]')) as l from documents where text is not null) select * from (select doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:5], '') as letters from t) where letters <> ''",
    "path_functions": f"select file_id, starts_with({_PATH}, 'core/') as in_core, lower(regexp_extract({_PATH}, '[^/]\\.([^./]+)$', 1)) as ext, regexp_matches(lower(filepath), 'example|sample|demo') as is_example, regexp_matches(lower({_PATH}), '{_TESTS}') as is_test, {_STEM} as stem, {_DIR} as dir from (select distinct file_id, filepath from source_files)",
    "comment_summaries": f"""with {_SYM}, t as (select symbol_id, trim(regexp_replace(coalesce(comment.body_preview, comment.summary_line), '\\s+', ' ', 'g')) as x from sym where comment is not null),
u as (select symbol_id, x, case when regexp_extract(x, '^[^.!?]*[.!?]') <> '' then regexp_extract(x, '^[^.!?]*[.!?]') else left(x, 120) end as s, left(x, 200) as p from t where x <> '')
select symbol_id, s as summary_line, case when p <> s then p end as body_preview, array_to_string(list_filter([case when contains(lower(x), 'deprecated') then 'Deprecated' end, case when contains(lower(x), 'experimental') then 'Experimental' end, case when contains(lower(x), '@internal') or contains(lower(x), 'internal use only') then 'Internal' end, case when contains(lower(x), 'unsafe') then 'Unsafe' end], lambda f: f is not null), ',') as flags from u""",
    "surface_counts": f"with {_SYM} select repo_id, case when kind = 'Function' then 'api' else 'type' end as surface, count(*) as n from sym where export.publicness in ('Public', 'Reexported') and kind in ('Function', 'Class', 'Struct', 'Enum', 'Interface', 'Module', 'Type', 'Trait') group by all",
    "report_totals": "select repo_id, sum(parsed_count)::bigint as parsed, sum(len(unsupported))::bigint as unsupported, sum(len(failed))::bigint as failed, sum(len(oversized))::bigint as oversized from (select distinct on (scan_id) * from parse_reports) group by repo_id",
    "cache_eviction": "with f as (select repo_id, file_id::varchar as path, max(size_bytes) as size, max(committed_at) as touched_at from source_files group by repo_id, file_id), k as (select *, sum(size) over (partition by repo_id order by touched_at desc, path desc rows unbounded preceding)::bigint as kept_size from f) select repo_id, path, size, kept_size from k where kept_size > 20000",
}

_IDENTIFIERS = r"list_sort(list_distinct(list_filter(regexp_split_to_array({}, '[^\p{{L}}\p{{M}}\p{{N}}_]'), lambda x: strlen(x) >= 2 and regexp_matches(x, '^[\p{{L}}_]'))))"
SQL["markdown_table"] = rf"""with {_SEC}, part as (select repo_id, {_PATH} as filepath, ordinal, section_id, coalesce(repeat('#', least(greatest(len(heading_hierarchy), 1), 6)::int) || ' ' || section_title || chr(10) || coalesce(content, ''), content) as text from sec),
file as (select repo_id, filepath, string_agg(text, chr(10) order by ordinal, section_id) as content from part group by all),
raw as (select repo_id, filepath, unnest(string_split(case when suffix(content, chr(10)) then left(replace(content, chr(13) || chr(10), chr(10)), -1) else replace(content, chr(13) || chr(10), chr(10)) end, chr(10))) as line, generate_subscripts(string_split(case when suffix(content, chr(10)) then left(replace(content, chr(13) || chr(10), chr(10)), -1) else replace(content, chr(13) || chr(10), chr(10)) end, chr(10)), 1) as i from file where content is not null),
f as (select *, starts_with(ltrim(line, ' '), '```') as fence, sum(starts_with(ltrim(line, ' '), '```')::int) over (partition by repo_id, filepath order by i) as fences, sum(starts_with(ltrim(line, ' '), '```')::int) over (partition by repo_id, filepath) as all_fences from raw),
d as (select *, case when not fence and fences % 2 = 0 and trim(regexp_extract(line, '^\s*#{{1,6}} (.*)$', 1)) <> '' then length(regexp_extract(line, '^\s*(#{{1,6}}) ', 1)) end as depth from f),
n as (select *, count(depth) over (partition by repo_id, filepath order by i) as section from d),
code as (select repo_id, filepath, section, fences, {_IDENTIFIERS.format("string_agg(line, chr(10) order by i)")} as names from n where not fence and fences % 2 = 1 and fences < all_fences group by all),
names as (select repo_id, filepath, section, flatten(list(names order by fences)) as names from code group by all),
cut as (select repo_id, filepath, section, max(case when depth is not null then trim(regexp_extract(line, '^\s*#{{1,6}} (.*)$', 1)) end) as title, max(depth) as depth, min(i) as first, max(i) as last, coalesce(trim(string_agg(line, chr(10) order by i) filter (depth is null), ' ' || chr(10) || chr(9) || chr(13)), '') as content from n group by all),
up as (select b.repo_id, b.filepath, b.section, list(a.title order by a.section) as titles from cut a join cut b using (repo_id, filepath) where a.depth is not null and (a.section = b.section or a.section < b.section and a.depth < b.depth) and not exists (select 1 from cut c where c.repo_id = a.repo_id and c.filepath = a.filepath and c.section > a.section and c.section <= b.section and c.depth <= a.depth) group by all),
kept as (select c.*, coalesce(m.names, []) as names, coalesce(u.titles, []) as titles from cut c left join names m using (repo_id, filepath, section) left join up u using (repo_id, filepath, section) where regexp_matches(c.content, '\S') or c.title is not null and len(coalesce(m.names, [])) > 0),
every as (select repo_id, filepath, section, coalesce(title, 'Introduction') as section_title, titles, content, names, first as start_line, last as end_line from kept
  union all select repo_id, filepath, 0, 'Introduction', [], trim(replace(content, chr(13) || chr(10), chr(10)), ' ' || chr(10) || chr(9) || chr(13)), {_IDENTIFIERS.format("content")}, 1, len(string_split(case when suffix(content, chr(10)) then left(replace(content, chr(13) || chr(10), chr(10)), -1) else replace(content, chr(13) || chr(10), chr(10)) end, chr(10))) from file where regexp_matches(content, '\S') and (repo_id, filepath) not in (select (repo_id, filepath) from kept))
select repo_id, filepath, row_number() over (partition by repo_id, filepath order by section) - 1 as ordinal, section_title, array_to_string(titles, ' / ') as headings, content, array_to_string(names, ',') as code_symbols, start_line, end_line from every"""

# The words that share a stem with a word of QUERY, and that stem; no other word's stem is one of these.
_FORMS = "buffers buffer, indexes index, indexed index, indexing index, readers reader, returns return, returned return, returning return, shared share, shares share, sharing share, stable stabl"
_FORM_OF = "case term " + " ".join("when '{}' then '{}'".format(*x.split()) for x in _FORMS.split(",")) + " else term end"
SQL["search_stemmed_hits"] = (
    f"with {_FIELDS}, {_ONE}, {_SCORED} select doc_id, doc_type, filepath, score from scored join docs using (doc_id) order by exact desc, doc_id limit 20".replace("dl, unnest(toks) as term from fields where toks is not null)", f"dl, {_FORM_OF} as term from (select *, unnest(toks) as term, least(len(toks), 65535) as dl from fields where toks is not null))")
    .replace("terms as (select doc_id, field_id, least(len(toks), 65535) as dl,", "terms as (select doc_id, field_id, dl,")
    .replace("q as (select 0 as query_id, unnest(", "q as (select query_id, qpos, " + _FORM_OF + " as term from (select 0 as query_id, unnest(")
    .replace(", 1) - 1 as qpos)", ", 1) - 1 as qpos))")
)

# -- the overview in SQL --------------------------------------------------------------------

# Stems that differ from the word, of the words that names of the test tables consist of.
_STEMS = """bundle bundl, cache cach, cached cach, corpe corp, decode decod, denpe denp, encode encod, entry entri, galpe galp, kelpe kelp, lazy lazi, linpe linp, merge merg, merpe merp, nested nest,
norpe norp, obagal obag, obamer obam, parse pars, pending pend, posting post, quape quap, query queri, remote remot, resolve resolv, rinpe rinp, shared share, sohugal sohug, ulpe ulp, validate valid,
wexpe wexp, yorpe yorp, zanpe zanp"""
_STEM_OF = "case w " + " ".join("when '{}' then '{}'".format(*x.split()) for x in _STEMS.split(",")) + " else w end"
_NAME = f"list_sort(list_distinct(list_transform({_parts('name')}, lambda w: {_STEM_OF})))"
_TYPES = "('Class', 'Struct', 'Enum', 'Interface', 'Module', 'Type', 'Trait')"
_ENDINGS = "['ts', 'tsx', 'js', 'jsx', 'mts', 'cts', 'mjs', 'cjs']"
_TARGETS = f"""{_SYM}, re as (select distinct on (reexport_id) *, {_PATH} as path from reexports),
mods as (select repo_id, reexport_id, local_name, exported_name, source_specifier is null as own, case when source_specifier is null then path when starts_with(source_specifier, '.') then
  ltrim(list_reduce(list_concat([''], list_filter(string_split({_DIR} || '/' || source_specifier, '/'), lambda x: x not in ('', '.'))), lambda a, x: case when x = '..' then regexp_replace(a, '/?[^/]*$', '') else a || '/' || x end), '/') end as module from re),
tried as (select distinct repo_id, reexport_id, local_name, exported_name, unnest(case when own or regexp_matches(module, '[^/]\\.[^./]+$') then [module] else list_concat(list_transform({_ENDINGS}, lambda e: module || '.' || e), list_transform({_ENDINGS}, lambda e: module || '/index.' || e)) end) as path from mods where module is not null),
met as (select t.*, s.symbol_id, s.name, s.ordinal, s.export from tried t join sym s on s.repo_id = t.repo_id and replace(s.filepath, '\\', '/') = t.path),
one as (select *, row_number() over (partition by repo_id, reexport_id order by path, ordinal, symbol_id) as n from met where local_name <> '*' and (name = local_name or local_name = 'default' and export.export_kind = 'Default')),
hops as (select repo_id, reexport_id as rid, symbol_id as sid, exported_name from one where n = 1
  union all select repo_id, reexport_id, symbol_id, name from met where local_name = '*' and exported_name = '*' and export.publicness in ('Public', 'Reexported') and coalesce(export.export_kind <> 'Default', true))"""
_CARDS = f"""{_TARGETS},
kinds as (select *, {_PATH} as path, case when kind = 'Function' then 'api' when kind in {_TYPES} then 'type' end as surface from sym),
public as (
  select repo_id, surface, symbol_id as id, name, path, start_line, coalesce(signature_preview, name) as signature, export.publicness as publicness, 0.0::double as extra, false as fallback, kind, comment.summary_line as said, comment.flags as flags, comment.summary_line as summary from kinds where surface is not null and export.publicness in ('Public', 'Reexported')
  union all select h.repo_id, k.surface, h.sid, h.exported_name, r.path, r.start_line, case when k.kind = 'Function' then h.exported_name || '(' || array_to_string(coalesce(k.params, []), ', ') || ')' else h.exported_name end, 'Reexported', 0.1, false, k.kind, k.comment.summary_line, k.comment.flags, k.comment.summary_line
    from hops h join re r on r.repo_id = h.repo_id and r.reexport_id = h.rid join kinds k on k.repo_id = h.repo_id and k.symbol_id = h.sid where k.surface is not null
  union all select repo_id, 'type', null, exported_name, path, start_line, exported_name, 'Reexported', 0.1, false, 'Module', null, [], 'namespace re-export from ' || source_specifier from re where local_name = '*' and exported_name <> '*'),
base as (select * from public union all
  select repo_id, surface, symbol_id, name, path, start_line, coalesce(signature_preview, name), export.publicness, 0.0, true, kind, comment.summary_line, comment.flags, comment.summary_line from kinds where surface is not null and export.publicness = 'Unknown' and repo_id not in (select repo_id from public)),
a as (select repo_id, symbol_id, {_NAME} as words, {_STEM} as stem, {_DIR} as dir from sym where symbol_id in (select id from base where surface = 'api')),
t as (select repo_id, symbol_id as test_id, name as test_name, {_NAME} as test_words, {_STEM} as test_stem, {_DIR} as test_dir, {_PATH} as test_path, 'test:' || {_PATH} || '#' || name || '@L' || start_line as test_ref from sym where regexp_matches(lower({_PATH}), '{_TESTS}') or starts_with(name, 'test')),
j as (select *, list_filter([case when len(list_filter(words, lambda x: not contains(lower(test_path), x))) = 0 then 'TestPathMatch' end, case when len(list_filter(words, lambda x: not list_contains(test_words, x))) = 0 then 'TestNameMatch' end, case when stem = test_stem then 'FileStemMatch' end, case when dir <> '' and dir = test_dir then 'DirectoryProximity' end], lambda x: x is not null) as reasons from a join t using (repo_id)),
r as (select *, row_number() over (partition by repo_id, symbol_id order by len(reasons) desc, test_path, test_ref, test_id) as rank from j where len(reasons) > 0),
links as (select repo_id, symbol_id, rank, test_id, test_path, test_ref, test_name, reasons, len(reasons) + 0.5::double as score from r where rank <= 3),
cards as (select b.repo_id, b.surface, b.id, b.name, b.path, b.kind, b.signature, b.publicness, case when b.id is null then summary else left(summary, 140) end as summary, array_to_string(coalesce(b.flags, []), ',') as flags, coalesce(l.linked, 0) as linked, b.fallback,
  round(case when b.id is null then 2.1::double else (case when b.surface = 'api' then 3.0::double else 2.0::double end + case when said is not null then 0.3::double else 0.0::double end + case when len(coalesce(b.flags, [])) > 0 then 0.2::double else 0.0::double end + case when coalesce(l.linked, 0) > 0 then 1.5::double else 0.0::double end - case when contains(b.path, '/examples/') then 0.7::double else 0.0::double end) + extra end, 4) as score,
  b.surface || ':' || b.path || '#' || b.name || '@L' || b.start_line as ref
  from base b left join (select repo_id, symbol_id, count(*) as linked from links group by all) l on b.surface = 'api' and l.repo_id = b.repo_id and l.symbol_id = b.id),
shown as (select * from (select *, row_number() over (partition by repo_id, surface order by score desc, path, ref, id) as rank from cards) where rank <= 6),
pairs as (select c.repo_id, c.ref, -c.score as place, c.path, l.test_ref, l.test_path, l.test_name, l.reasons, l.score, l.rank from cards c join links l on c.surface = 'api' and l.repo_id = c.repo_id and l.symbol_id = c.id),
totals as (select repo_id, test_ref, min(test_path) as test_path, min(test_name) as test_name, max(score) as score, count(distinct ref) as symbols from pairs group by repo_id, test_ref),
tests as (select * from (select *, row_number() over (partition by repo_id order by score desc, test_path, test_ref) as rank from totals) where rank <= 6),
hinted as (select repo_id, case when surface = 'api' then rank else 3 end as place, 'InspectSymbol' as action, ref as target, signature as label, case when surface = 'api' then 'top public API' else 'top public type' end as reason from shown where surface = 'api' and rank <= 2 or rank <= 1
  union all select repo_id, 4, 'ReadPath', test_path, test_name, 'top linked test' from tests where rank = 1),
cover as (select r.repo_id, s.unknown, s.said, x.every_linked, x.some_linked, coalesce(n.apis, 0) > 6 or coalesce(n.types, 0) > 6 or coalesce(m.n, 0) > 6 as truncated, coalesce(n.fallback, false) as fallback
  from (select repo_id from sym union select repo_id from cards) r
  left join (select repo_id, bool_or(coalesce(export.publicness = 'Unknown', false)) as unknown, bool_and(comment is not null) as said from kinds where surface is not null group by repo_id) s using (repo_id)
  left join (select repo_id, bool_and(linked > 0) as every_linked, bool_or(linked > 0) as some_linked from shown where surface = 'api' group by repo_id) x using (repo_id)
  left join (select repo_id, count(*) filter (surface = 'api') as apis, count(*) filter (surface = 'type') as types, bool_or(fallback) as fallback from cards group by repo_id) n using (repo_id)
  left join (select repo_id, count(*) as n from totals group by repo_id) m using (repo_id)),
states as (select repo_id, case when unknown is null then 'Unsupported' when unknown then 'Partial' else 'Complete' end as publicness, case when said is null then 'Unsupported' when said then 'Complete' else 'Partial' end as comments, case when every_linked then 'Complete' when some_linked then 'Partial' else 'Unsupported' end as tests, fallback, truncated from cover)"""
SQL |= {
    "reexport_targets": f"with {_TARGETS} select repo_id, rid, sid, exported_name from hops",
    "test_links": f"with {_CARDS} select repo_id, symbol_id, rank, test_id, array_to_string(reasons, ',') as reasons, score from links",
    "test_totals": f"with {_CARDS} select repo_id, test_ref, test_path, test_name, score, symbols from totals",
    "test_cards": f"""with {_CARDS}, lists as (select repo_id, test_ref, list(ref order by place, path, ref) as refs, flatten(list(reasons order by place, path, ref)) as why from pairs group by repo_id, test_ref)
select t.repo_id, t.rank, t.test_ref, t.test_path, t.test_name, array_to_string(list_filter(refs, lambda x, i: list_position(refs, x) = i), ' ') as linked_symbols, array_to_string(list_filter(why, lambda x, i: list_position(why, x) = i), ',') as reasons, t.score from tests t join lists using (repo_id, test_ref)""",
    "surface_all": f"with {_CARDS} select repo_id, surface, ref, kind, signature, publicness, summary, flags, linked, score, fallback from cards",
    "surface_cards": f"with {_CARDS} select repo_id, surface, rank, ref, signature, publicness, linked, score from shown",
    "surface_hints": f"with {_CARDS} select repo_id, row_number() over (partition by repo_id order by place) as rank, action, target, label, reason from hinted",
    "surface_coverage": f"""with {_CARDS} select repo_id, publicness, comments, tests, array_to_string(list_filter([case when publicness = 'Partial' then 'some symbol publicness values remain unknown' end, case when comments = 'Partial' then 'some surfaced symbols have no normalized comment summary' end, case when tests = 'Partial' then 'linked tests were found for only part of the public API surface' end,
  case when fallback then 'overview fell back to symbols with unknown publicness' end, case when truncated then 'overview output truncated by render budget' end], lambda x: x is not null), '; ') as notes, truncated from states""",
}
