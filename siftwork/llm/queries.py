"""Registered queries of the numbered problems, over the whole tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text_tokens
from ..sources.tables import table
from . import contamination, documented_functions, generated_code, mixing, parse_failures, reading_level, splitting, term_frequency


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = documented_functions.pairs(table(spark, folder, "source_files"))
    return rows.where("parses").select("file_id", "name", "start_line").distinct()


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return documented_functions.pairs(table(spark, folder, "source_files"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return parse_failures.unparsable(table(spark, folder, "source_files")).select("file_id")


def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    return parse_failures.failure_rates(table(spark, folder, "source_files"), table(spark, folder, "parse_reports"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return term_frequency.term_frequencies(table(spark, folder, "postings")).where("mark is not null").select("term", "mark")


def p2_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return term_frequency.term_frequencies(table(spark, folder, "postings"))


def p2_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Every run of up to three words of the sections, with its occurrences and the sections that hold it."""
    sections = table(spark, folder, "doc_sections").dropDuplicates(["section_id"]).select("section_id", text_tokens("content").alias("tokens"))
    return term_frequency.ngrams(sections, "section_id", "tokens", 3).select(F.array_join("gram", " ").alias("gram"), "occurrences", "records")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.cut_kinds(table(spark, folder, "doc_sections"))


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.pieces(table(spark, folder, "doc_sections")).distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = generated_code.not_handwritten(table(spark, folder, "source_files"), table(spark, folder, "parse_reports"))
    return rows.select("file_id").distinct()


def p5_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return generated_code.not_handwritten(table(spark, folder, "source_files"), table(spark, folder, "parse_reports"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "eval_items")
    return contamination.leaked_items(contamination.leaks(table(spark, folder, "documents"), items), items)


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "source_weights")).records


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "source_weights")).report


def p7_shares_strict(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "source_weights"), "strict").report


def p7_mixture_full(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "source_weights"), "all").records


def p7_shares_full(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "source_weights"), "all").report


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return reading_level.reading_levels(table(spark, folder, "documents"), table(spark, folder, "reading_labels")).select("doc_id", "band")


def p8_profile(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return reading_level.profile(documents, reading_level.reading_levels(documents, table(spark, folder, "reading_labels")))


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p2_found, p2_frequencies, p2_ngrams, p3_found, p3_pieces, p4_found, p4_rates, p5_found, p5_reasons, p6_found, p6_items, p7_mixture, p7_shares, p7_shares_strict, p7_mixture_full, p7_shares_full, p8_found, p8_profile)}
SQL: dict[str, str] = {
    "p2_frequencies": """
with once as (select distinct build_id, doc_id, field_id, term, segment_no, tf from postings where term is not null),
counts as (select lower(regexp_replace(nfc_normalize(term), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) as term, sum(tf)::bigint as occurrences, count(distinct doc_id) as records from once group by 1)
select term, occurrences, records, case when occurrences <= 3 then 'rare' when records >= 0.3 * (select count(distinct doc_id) from postings) then 'common' end as mark from counts""",
}
SQL["p2_ngrams"] = """
with sec as (select distinct on (section_id) section_id, content from doc_sections),
toks as (select section_id, list_filter(regexp_extract_all(lower(content), '[\\p{L}\\p{M}\\p{N}_]+'), lambda w: strlen(w) between 2 and 79) as t from sec where content is not null),
places as (select section_id, t, unnest(range(1, len(t) + 1)) as i from toks),
grams as (select section_id, array_to_string(t[i:i + n - 1], ' ') as gram from places, (values (1), (2), (3)) sizes(n) where i + n - 1 <= len(t))
select gram, count(*) as occurrences, count(distinct section_id) as records from grams group by gram"""
# A block is a fence with all between, or a run of lines that are neither blank nor in a fence.
SQL["p3_found"] = """
with long as (select distinct on (section_id) section_id, content from doc_sections where length(content) > 2000),
raw as (select section_id, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as i from long),
l as (select section_id, i, regexp_replace(line, '\\r+$', '') as bare, regexp_matches(line, '^\\s*```') as mark, regexp_matches(line, '\\S') as solid, coalesce(sum(length(line) + 1) over (partition by section_id order by i rows between unbounded preceding and 1 preceding), 0) as start from raw),
f as (select *, start + length(bare) as stop, coalesce(sum(mark::int) over (partition by section_id order by i), 0) as marks, sum(mark::int) over (partition by section_id) as all_marks from l),
g as (select *, mark or marks % 2 = 1 as fenced from f),
h as (select *, sum((fenced or not solid)::int) over (partition by section_id order by i) as gaps from g),
b as (
  select section_id, max(stop) - min(start) as size from h where fenced and (solid or (marks + 1) // 2 * 2 <= all_marks) group by section_id, (marks + 1) // 2
  union all select section_id, max(stop) - min(start) from h where solid and not fenced group by section_id, gaps),
m as (select section_id, max(length(bare)) filter (solid) as line from l group by section_id)
select section_id, case when coalesce((select max(size) from b where b.section_id = m.section_id), 0) <= 2000 then 'block' when line <= 2000 then 'line' else 'inside' end as cut_kind from m"""
SQL["p2_found"] = f"select term, mark from ({SQL['p2_frequencies']}) where mark is not null"
