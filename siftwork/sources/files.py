"""Repository snapshots as tables of files."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE_LIMIT = 10 * 1024 * 1024


def ignore_rules(root: str) -> list[tuple[str, bool]]:
    """(regular expression on the path from the root, whether it takes files back in) of every ignore
    file: the repository's own exclude list, then .gitignore files from the top down.  The last
    rule that a path fits counts."""
    found = [("", os.path.join(root, ".git", "info", "exclude"))]
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if not d.startswith("."))
        if ".gitignore" in names:
            rel = os.path.relpath(folder, root).replace(os.sep, "/")
            found.append(("" if rel == "." else rel + "/", os.path.join(folder, ".gitignore")))
    rules = []
    for base, path in found:
        if not os.path.isfile(path):
            continue
        with open(path, encoding="utf-8", errors="replace") as f:
            for line in map(str.rstrip, f):
                if line and line[0] != "#":
                    negated = line[0] == "!"
                    rules.append((_regex(line[negated:].removeprefix("\\"), base), negated))
    return rules


def _regex(pattern: str, base: str = "") -> str:
    """A pattern of an ignore file in a folder as a regular expression on the path from the root."""
    only_dir, anchored = pattern.endswith("/"), "/" in pattern.rstrip("/")
    out, i, body = "", 0, pattern.strip("/")
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            out, i = out + "[" + body[i + 1 : end].replace("!", "^", body[i + 1] == "!") + "]", end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(body[i], re.escape(body[i])), i + 1
    return "^" + re.escape(base) + ("" if anchored else "(?:.*/)?") + out + ("/" if only_dir else "(?:/|$)")


def scan(spark: SparkSession, root: str, ignore: list[tuple[str, bool]] | None = None) -> DataFrame:
    """(filepath, size_bytes, content, is_oversized) of every file below a folder.

    Hidden files and folders and ignored paths are left out; content is null for files over
    the limit, which are not read; files that are not UTF-8 are dropped.  Without files the
    table is empty.
    """
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = os.path.abspath(root)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^\\Q" + base.rstrip("/") + "\\E/", "")
    named = every.withColumn("filepath", F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))
    visible = named.where(~F.col("filepath").rlike(r"(?:^|/)\."))
    ignored = F.lit(False)
    for pattern, negated in ignore_rules(root) if ignore is None else ignore:
        ignored = F.when(F.col("filepath").rlike(pattern), F.lit(not negated)).otherwise(ignored)
    visible = visible.where(~ignored)
    large = visible.where(F.col("length") > SIZE_LIMIT).select("filepath", F.col("length").alias("size_bytes"), F.lit(None).cast("string").alias("content"), F.lit(True).alias("is_oversized"))
    small = visible.where(F.col("length") <= SIZE_LIMIT).where(F.is_valid_utf8(F.col("content")))
    read = small.select("filepath", F.col("length").alias("size_bytes"), F.decode("content", "utf-8").alias("content"), F.lit(False).alias("is_oversized"))
    return read.unionByName(large)


def from_rows(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """Files held in memory, for use as a library."""
    df = spark.createDataFrame(rows, "filepath string, content string")
    return df.select("filepath", F.octet_length("content").cast("long").alias("size_bytes"), "content", F.lit(False).alias("is_oversized"))
