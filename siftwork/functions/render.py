"""Results as JSON lines and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_lines(results: DataFrame) -> DataFrame:
    """One {"Code": ...} or {"Doc": ...} object a row (column value); the empty arm is left out."""
    code = F.struct("filepath", "name", "kind", "start_line", "end_line", "is_example", "score")
    doc = F.struct("filepath", "section", "snippet", "start_line", "end_line", "score")
    arms = F.struct(F.when(F.col("doc_type") == "Code", code).alias("Code"), F.when(F.col("doc_type") == "Doc", doc).alias("Doc"))
    return results.select(F.to_json(arms).alias("value"))


def text_line() -> Column:
    """[code] file:a-b  Kind name  (score: 1.234), or [doc]  file#section  "first 80 characters..."  (score: 1.234)"""
    mark = F.when(F.col("is_example"), "[example]").otherwise("[code]")
    code = F.format_string("%s %s:%d-%d  %s %s  (score: %.3f)", mark, "filepath", "start_line", "end_line", "kind", "name", F.col("score").cast("double"))
    doc = F.format_string('[doc]  %s#%s  "%s..."  (score: %.3f)', F.col("filepath"), F.col("section"), F.left("snippet", F.lit(80)), F.col("score").cast("double"))
    return F.when(F.col("doc_type") == "Code", code).otherwise(doc)


def overview_json(meta: DataFrame, shown: DataFrame, tests: DataFrame, hints: DataFrame, repo: str, *keys: str) -> DataFrame:
    """One object (column value) for each key: meta, public_apis, public_types, public_api_tests, entry_hints.
    The lists are those of a report, a few rows each."""
    k = list(keys)

    def listed(rows: DataFrame, name: str, row) -> DataFrame:
        return rows.groupBy(*k).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", row.alias("row")))), lambda x: x["row"]).alias(name))

    links = F.transform("tests", lambda t: F.struct(t["test_ref"].alias("test_ref"), t["test_path"].alias("filepath"), t["test_name"].alias("display_name"), t["reasons"].alias("reasons"), t["score"].alias("score")))
    head = (F.col("ref").alias("symbol_ref"), "filepath", "signature", F.col("summary").alias("comment_summary"), "flags", "publicness")
    parts = [
        listed(shown.where("surface = 'api'"), "public_apis", F.struct(*head, F.coalesce(links, F.array().cast(_LINKS)).alias("tests"), "score")),
        listed(shown.where("surface = 'type'"), "public_types", F.struct(*head[:2], "kind", *head[2:], "score")),
        listed(tests, "public_api_tests", F.struct("test_ref", F.col("test_path").alias("filepath"), F.col("test_name").alias("display_name"), "linked_symbols", "reasons", "score")),
        listed(hints, "entry_hints", F.struct("action", "target", "label", "reason")),
    ]
    coverage = F.struct("publicness", F.col("comments").alias("comment_normalization"), F.col("tests").alias("test_linkage"), "notes")
    whole = meta.select(*k, F.struct(F.lit(repo).alias("repo"), coverage.alias("coverage"), "truncated").alias("meta"))
    names = ("public_apis", "public_types", "public_api_tests", "entry_hints")
    for part, name in zip(parts, names):
        whole = whole.join(part, k, "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return whole.select(*k, F.to_json(F.struct("meta", *names), {"ignoreNullFields": "false"}).alias("value"))


_LINKS = "array<struct<test_ref:string,filepath:string,display_name:string,reasons:array<string>,score:double>>"
_VERBS = {"InspectSymbol": "inspect", "SearchQuery": "search", "ReadPath": "read"}


def overview_lines(report: dict) -> list[str]:
    """The text form of one overview object."""
    meta, out = report["meta"], []
    c = meta["coverage"]
    out += [f"repo: {meta['repo']}", f"coverage: publicness={c['publicness']}, comments={c['comment_normalization']}, tests={c['test_linkage']}"]
    out += ["truncated: true"] * meta["truncated"] + [f"note: {n}" for n in c["notes"]] + ["public_api:"]
    for card in report["public_apis"]:
        out.append(f"  {card['signature']}  {card['filepath']}")
        out += [f"    doc: {card['comment_summary']}"] if card["comment_summary"] is not None else []
        out += [f"    flags: {', '.join(f.lower() for f in card['flags'])}"] if card["flags"] else []
        out += [f"    tests: {', '.join(t['display_name'] for t in card['tests'])}"] if card["tests"] else []
    out.append("public_types:")
    for card in report["public_types"]:
        out.append(f"  {card['signature']} ({card['kind']})  {card['filepath']}")
        out += [f"    doc: {card['comment_summary']}"] if card["comment_summary"] is not None else []
    out += ["public_api_tests:", *(f"  {t['display_name']}  {t['filepath']}" for t in report["public_api_tests"])]
    return [*out, "entry_hints:", *(f"  {_VERBS[h['action']]} {h['label']} ({h['reason']})" for h in report["entry_hints"])]


def parse_report_lines(report) -> list[str]:
    """Lines of one report row; None stands for a snapshot that was not parsed, as its stored form fitted."""
    if report is None:
        return ["verbose: cached, nothing was parsed"]
    out = [f"verbose: parsed {report['parsed_count']} files"]
    for kind in ("unsupported", "failed", "oversized"):
        out += [f"{kind}: {p}" for p in report[kind]]
    return out
