"""Source files to symbols, re-exports and a parse report: a map over files, Python only inside tasks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..parsing import languages
from ..parsing.declarations import reexports as _reexports
from ..parsing.declarations import symbols as _symbols

SIZE_LIMIT = 10 * 1024 * 1024
#: Extensions that the scanner hands to a parser; of these only languages.EXTENSIONS and Markdown have one here.
MARKDOWN = ("md", "mdx")
_MORE = {"jsx": "tsx", "cts": "typescript", "pyi": "python"}


def language() -> Column:
    """The language of filepath by the text after the last dot of the path, case counts."""
    every = languages.EXTENSIONS | _MORE
    pairs = [x for k, v in every.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), F.substring_index("filepath", ".", -1))


_SYMBOLS = "struct<name:string,kind:string,start_line:int,end_line:int,params:array<string>,comment:string,comment_source:string,publicness:string,export_kind:string,container:string>"
_REEXPORTS = "struct<start_line:int,end_line:int,local_name:string,exported_name:string,source_specifier:string,is_type_only:boolean>"


def _run(keys: list[str]):
    types = {
        "symbols": pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("params", pa.list_(pa.string())), ("comment", pa.string()), ("comment_source", pa.string()), ("publicness", pa.string()), ("export_kind", pa.string()), ("container", pa.string())])),
        "reexports": pa.list_(pa.struct([("start_line", pa.int32()), ("end_line", pa.int32()), ("local_name", pa.string()), ("exported_name", pa.string()), ("source_specifier", pa.string()), ("is_type_only", pa.bool_())])),
    }

    def run(batches):
        for b in batches:
            status, found, again = [], [], []
            for lang, text in zip(b.column("language").to_pylist(), b.column("content").to_pylist()):
                p = languages.read(text, lang)
                found.append([vars(s) | {"comment": _plain(s.comment)} for s in _symbols(p)])
                again.append([vars(r) for r in _reexports(p)])
                blank = not text.strip()
                status.append("Ok" if p.ok and (found[-1] or again[-1] or blank or lang not in ("typescript", "tsx", "javascript")) else "Failed")
            cols = [*(b.column(k) for k in keys), pa.array(status), pa.array(found, types["symbols"]), pa.array(again, types["reexports"])]
            yield pa.RecordBatch.from_arrays(cols, [*keys, "status", "symbols", "reexports"])

    return run


def _plain(comment: str | None) -> str | None:
    """A comment without its delimiters; a third slash of /// stays, as the scanner leaves it."""
    if comment is None:
        return None
    lines = []
    for line in comment.split("\n"):
        s = line.strip()
        for mark in ("/**", "/*"):
            s = s.removeprefix(mark)
        s = s.removesuffix("*/").strip()
        s = s.removeprefix("//") if s.startswith("//") else s.removeprefix("#") if s.startswith("#") else s.removeprefix("*")
        lines.append(s.strip())
    return "\n".join(lines).strip()


def parsed(files: DataFrame, *keys: str) -> DataFrame:
    """(keys, filepath, language, status, symbols, reexports) of each file.

    status is Ok, Unsupported (no parser for the extension), Failed or Oversized (over the
    limit, or without content).  Only supported files with content go to Python.
    """
    names = [*keys, "filepath", "language"]
    base = files.withColumn("language", language()).select(*names, "content")
    too_long = F.octet_length("content") > SIZE_LIMIT
    ready = base.where(F.col("language").isNotNull() & F.col("content").isNotNull() & ~too_long)
    types = dict(base.dtypes)
    schema = ", ".join(f"`{n}` {types[n]}" for n in names) + f", status string, symbols array<{_SYMBOLS}>, reexports array<{_REEXPORTS}>"
    done = ready.mapInArrow(_run(names), schema)
    rest = base.where(F.col("language").isNull() | F.col("content").isNull() | too_long)
    other = rest.select(*names, F.when(F.col("content").isNull() | too_long, "Oversized").otherwise("Unsupported").alias("status"), F.lit(None).cast(f"array<{_SYMBOLS}>").alias("symbols"), F.lit(None).cast(f"array<{_REEXPORTS}>").alias("reexports"))
    return done.unionByName(other)


def symbols(files: DataFrame, *keys: str) -> DataFrame:
    """The symbols of all files, in the row type of the tables."""
    one = parsed(files, *keys).where("status = 'Ok'").select(*keys, "filepath", F.posexplode("symbols").alias("ordinal", "s"))
    export = F.struct(F.col("s.publicness").alias("publicness"), F.col("s.export_kind").alias("export_kind"), F.col("s.container").alias("container"))
    return one.select(
        *keys, F.col("s.name").alias("name"), F.col("s.kind").alias("kind"), "filepath", F.col("s.start_line").alias("start_line"), F.col("s.end_line").alias("end_line"), F.col("s.params").alias("params"),
        X.signature(F.col("s.kind"), F.col("s.name"), F.col("s.params")).alias("signature_preview"), X.comment_info(F.col("s.comment"), F.col("s.comment_source")).alias("comment"), export.alias("export"), "ordinal",
    )


def reexports(files: DataFrame, *keys: str) -> DataFrame:
    one = parsed(files, *keys).where("status = 'Ok'").select(*keys, "filepath", F.posexplode("reexports").alias("ordinal", "r"))
    return one.select(*keys, "filepath", "r.*", "ordinal")


def report(done: DataFrame, *keys: str) -> DataFrame:
    """Per key: files parsed, and the sorted paths of those that failed, are unsupported or too large."""

    def paths(status: str):
        return F.array_sort(F.collect_list(F.when(F.col("status") == status, F.col("filepath"))))

    return done.groupBy(*keys).agg(F.count_if(F.col("status") == "Ok").alias("parsed_count"), paths("Unsupported").alias("unsupported"), paths("Failed").alias("failed"), paths("Oversized").alias("oversized"))
