"""Problem 4: source files that do not parse in the language of their extension.

Every file is parsed by generalised LL over a graph-structured stack with the dialects of
its language, and a file that every dialect rejects is flagged.  Dialects run one after the
other until one takes the file, which comes to the same as running them at once
(languages.together, compared in the tests) and leaves one reading of nearly every token.  One pass over the table, without a shuffle before the (narrow) result.

Defined results: rows without content, without a path or of an unsupported extension
are not judged; blank files and files of comments parse; a repeated row gives its file
once; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..parsing import languages

_OUT = "file_id bigint, language string, dialect string, ok boolean, error_line int"


def extension() -> Column:
    """Text after the last dot of the file name; null where there is none."""
    return F.nullif(F.regexp_extract("filepath", r"[^/\\]\.([^./\\]+)$", 1), F.lit(""))


def language() -> Column:
    pairs = [x for k, v in languages.EXTENSIONS.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), extension())


def _parse(batches):
    for b in batches:
        ids, langs, texts = (b.column(c).to_pylist() for c in ("file_id", "language", "content"))
        ok, dialect, line = [], [], []
        for lang, text in zip(langs, texts):
            known = languages.recognises(text, lang)
            ok.append(known is not None)
            dialect.append(known)
            if known:
                line.append(None)
                continue
            p = languages.read(text, lang)
            line.append(p.tokens.lines[min(p.failed_at, len(p.tokens.lines) - 1)])
        langs = [languages.FAMILIES.get(x, x) for x in langs]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(dialect, pa.string()), pa.array(ok, pa.bool_()), pa.array(line, pa.int32())], ["file_id", "language", "dialect", "ok", "error_line"])


def parsed_files(files: DataFrame) -> DataFrame:
    """(file_id, language, dialect, ok, error_line) for each row with content of a supported language;
    dialect is the one that took the file, error_line the line that the furthest one stopped at."""
    judged = files.select(F.col("file_id").cast("long").alias("file_id"), language().alias("language"), "content").where("language is not null and content is not null")
    return judged.mapInArrow(_parse, _OUT)


def unparsable(files: DataFrame) -> DataFrame:
    """(file_id, language, error_line): the files that no dialect of their language takes."""
    return parsed_files(files).where("not ok").select("file_id", "language", "error_line").distinct()


def failure_rates(files: DataFrame, reports: DataFrame) -> DataFrame:
    """Per repository and language: files judged, files that fail and their rate, set against
    the scanner's reports (files it parsed, failed, and skipped as unsupported in the repository;
    failed_reported counts those of the language, missed those that it let through)."""
    ids = files.select("file_id", "repo_id", "filepath").distinct()
    flags = parsed_files(files).groupBy("file_id", "language").agg((~F.bool_and("ok")).alias("fails"))
    reported = reports.select("repo_id", F.explode("failed").alias("f")).select("repo_id", F.col("f.path").alias("filepath")).where("filepath is not null").distinct().withColumn("reported", F.lit(True))
    once = reports.select("scan_id", "repo_id", "parsed_count", F.size("unsupported").alias("n")).distinct()
    scans = once.groupBy("repo_id").agg(F.sum("parsed_count").alias("parsed_reported"), F.sum("n").alias("unsupported_reported"))
    judged = flags.join(ids, "file_id").join(reported, ["repo_id", "filepath"], "left")
    by = judged.groupBy("repo_id", "language").agg(
        F.count("*").alias("files"),
        F.count_if("fails").alias("failing"),
        F.count_if("reported").alias("failed_reported"),
        F.count_if(F.col("fails") & F.col("reported").isNull()).alias("missed"),
    )
    return by.withColumn("rate", F.col("failing") / F.col("files")).join(scans, "repo_id", "left")
