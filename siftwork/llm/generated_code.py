"""Problem 5: source files that nobody wrote by hand.

One pass over the table.  A multi-pattern automaton looks for generation and third-party
notices in the comments that head a file; path rules know vendored and generated
folders, lock files and the suffixes of minified and generated files; the text itself
shows minified code (half of it or more in very long lines), data stored as code (seven tenths
of it or more literals, TABLE_LITERALS at least or in very long lines) and the evenly repeating declarations that
tools emit (EVEN_LINES lines at least); these numbers say what such a thing is, and hold
for texts of any size.  Files over the size
limit come without content and are judged by path, size and the scanner's reports.

Defined results: rows of an unsupported extension or without a path are never returned;
a blank or null content gives only path reasons; a repeated row gives its file once; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parse_failures import language

SIZE_LIMIT = 10 * 1024 * 1024
#: Characters of a very long line; literals that make a table; lines that make a repetition.
LONG_LINE, TABLE_LITERALS, EVEN_LINES = 400, 8, 12

# Phrases of notices, in lower case; folders and suffixes.
GENERATED_NOTICES = (
    "code generated by", "do not edit", "do not modify", "do not change by hand", "autogenerated", "auto-generated", "auto generated", "automatically generated", "automatically created",
    "automatically produced", "@generated", "machine generated", "machine-generated", "generated by ", "generated from ", "generated file", "generated code", "this file was generated",
    "this file is generated", "was produced by", "written by a tool", "manual changes will be lost", "changes will be lost", "edits are overwritten", "will be overwritten", "created by a tool",
)
THIRD_PARTY_NOTICES = ("upstream: http", "upstream source:", "contributors, released under", "vendored from", "copied from http", "imported from http", "homepage: http", "@license ")
VENDORED_FOLDERS = "vendor vendored third_party third-party thirdparty 3rdparty external externals deps node_modules bower_components jspm_packages Pods Carthage Godeps site-packages".split()
GENERATED_FOLDERS = "gen generated autogen auto_generated __generated__ generated-sources".split()
GENERATED_NAME = r"(?:[_.](?:pb2?|pb2_grpc|generated)|\.(?:gen|g|designer))\.\w+$|(?:^|/)(?:zz_generated|moc_|ui_|qrc_)[^/]*$"
MINIFIED_NAME = r"[.\-_](?:min|bundle|prod|packed|umd\.min)\.(?:js|mjs|cjs)$"
LOCK_NAME = r"(?:^|/)(?:[^/]*[.\-]lock(?:file)?|npm-shrinkwrap|lock)\.\w+$"

_CODE_HEAD = re.compile(r"#(?:\s*(?:include|define|if|ifdef|ifndef|pragma|undef|import|error)\b|!?\[)")
_WORD = re.compile(r"\w+")
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`[^`]*+`|(?<![\w.])-?(?:0[xX][\da-fA-F]+|\d[\d_.]*(?:[eE][+-]?\d+)?)\w*")
_WHITE = re.compile(r"\s+")


@cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, phrases in (("generated notice", GENERATED_NOTICES), ("third-party notice", THIRD_PARTY_NOTICES)):
        for p in phrases:
            a.add_word(p, kind)
    a.make_automaton()
    return a


def header(text: str) -> str:
    """The comments before the first line of code, in lower case."""
    out, block = [], ""
    for line in text.split("\n"):
        s = line.strip().removeprefix("﻿")
        if block:
            out.append(s)
            if block in s:
                block = ""
        elif not s:
            continue
        elif s.startswith("/*"):
            out.append(s)
            block = "" if "*/" in s[2:] else "*/"
            if not block and not s.endswith("*/"):
                break
        elif s[:3] in ('"""', "'''"):
            out.append(s)
            block = "" if s[:3] in s[3:] else s[:3]
        elif s.startswith("=begin"):
            block = "=end"
        elif s.startswith("//") or s.startswith("#") and not _CODE_HEAD.match(s) or s.startswith("--"):
            out.append(s)
        else:
            break
    return "\n".join(out).lower()


def evenly_repeating(text: str) -> bool:
    """Whether the lines, words masked, repeat with a short period throughout (EVEN_LINES or more)."""
    lines = [s for s in (x.strip() for x in _WORD.sub("w", text).split("\n")) if s and not s.startswith(("//", "#", "/*", "*"))]
    n = len(lines)
    if n < EVEN_LINES:
        return False
    return any(sum(a == b for a, b in zip(lines, lines[p:])) >= 0.8 * (n - p) for p in range(2, 9))


def reasons(text: str) -> list[str]:
    """What in a text speaks against a human author."""
    found = {kind for _, kind in _automaton().iter(header(text))}
    size = len(text)
    long = sum(len(line) for line in text.split("\n") if len(line) > LONG_LINE) if size > LONG_LINE else 0
    dense = _WHITE.sub("", text)
    if long or sum(map(dense.count, "0123456789")) > 0.25 * len(dense) or sum(map(dense.count, "\"'`")) > 0.05 * len(dense):
        bare, literals = _LITERAL.subn("", dense)
        blob = long >= 0.5 * size > 0
        if (blob or literals >= TABLE_LITERALS) and len(dense) - len(bare) >= 0.7 * len(dense):
            found.add("data")
        elif blob:
            found.add("minified")
    if evenly_repeating(text):
        found.add("evenly repeating")
    return sorted(found)


def path_reasons() -> Column:
    """Array of reasons that the path gives."""
    path = F.translate("filepath", "\\", "/")

    def folder(names: list[str]) -> Column:
        return path.rlike("(?:^|/)(?:" + "|".join(map(re.escape, names)) + ")/")

    rules = {"vendored folder": folder(VENDORED_FOLDERS), "generated folder": folder(GENERATED_FOLDERS), "generated name": path.rlike(GENERATED_NAME), "minified name": path.rlike(MINIFIED_NAME), "lock file": path.rlike(LOCK_NAME)}
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))


def _judge(batches):
    for b in batches:
        got = [reasons(t) if t else [] for t in b.column("content").to_pylist()]
        keep = [c for c in b.schema.names if c != "content"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(got, pa.list_(pa.string()))], [*keep, "content_reasons"])


def not_handwritten(files: DataFrame, reports: DataFrame) -> DataFrame:
    """(file_id, repo_id, filepath, reasons): the files of supported languages with some reason.

    Only a distinct of the flagged rows (without content) is shuffled; the scanner's list of
    oversized paths is joined to the rows that have no content.
    """
    base = files.select(F.col("file_id").cast("long").alias("file_id"), F.col("repo_id").cast("int").alias("repo_id"), F.col("filepath").cast("string").alias("filepath"), F.col("size_bytes").cast("long").alias("size_bytes"), "content").where(language().isNotNull()).withColumn("by_path", path_reasons())
    judged = base.where("content is not null").mapInArrow(_judge, "file_id bigint, repo_id int, filepath string, size_bytes bigint, by_path array<string>, content_reasons array<string>")
    texts = judged.select("file_id", "repo_id", "filepath", F.array_sort(F.concat("by_path", "content_reasons")).alias("reasons"))
    listed = reports.select("repo_id", F.explode("oversized").alias("filepath")).distinct().withColumn("listed", F.lit(True))
    empty = base.where("content is null").join(listed, ["repo_id", "filepath"], "left")
    size = F.when(F.col("listed") | (F.col("size_bytes") > SIZE_LIMIT), F.lit("oversized"))
    bare = empty.select("file_id", "repo_id", "filepath", F.array_sort(F.concat("by_path", F.array_compact(F.array(size)))).alias("reasons"))
    return texts.unionByName(bare).where(F.size("reasons") > 0).distinct()


def handwritten(files: DataFrame, reports: DataFrame) -> DataFrame:
    """The rows of supported languages that remain, once each file is counted once (latest delivery)."""
    flagged = not_handwritten(files, reports).select("file_id").distinct()
    return files.where(language().isNotNull()).join(flagged, "file_id", "left_anti")
