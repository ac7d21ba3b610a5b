"""Markdown files to sections, in built-in expressions and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def code_identifiers(text: Column) -> Column:
    """Words of a code block: two bytes or more, beginning with a letter or _, sorted, each once."""
    parts = F.split(text, r"[^\p{IsAlphabetic}\p{N}_]")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: (F.octet_length(x) >= 2) & x.rlike(r"^[\p{IsAlphabetic}_]"))))


def _blank(text: Column) -> Column:
    return ~text.rlike(r"\S")


def sections(files: DataFrame, *keys: str) -> DataFrame:
    """The sections of (keys..., filepath, content): section_title, heading_hierarchy, content, code_symbols,
    start_line, end_line, ordinal.

    ATX headings outside fences begin a section.  The hierarchy ends with the section's own
    title; text before the first heading is called Introduction.  A section without text is
    dropped unless it has code symbols; where none is left but the file is not blank, the whole
    file is one Introduction.  Only ``` opens or closes a fence; identifiers are read when one
    closes.  Windows run per file, so the largest task is one file.  Null contents give nothing.
    """
    by = [*keys, "filepath"]
    text = F.regexp_replace("content", r"\r?\n\z", "")
    lines = files.where("content is not null").select(*by, F.posexplode(F.split(text, r"\r?\n")).alias("i", "line"))
    w = Window.partitionBy(*by).orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    fence = F.ltrim("line").startswith("```")
    marked = lines.withColumn("fence", fence).withColumn("fences", F.sum(F.col("fence").cast("int")).over(upto))
    outside = ~F.col("fence") & (F.col("fences") % 2 == 0)
    title = F.trim(F.regexp_extract("line", r"^\s*#{1,6} (.*)$", 1))
    heads = marked.withColumn("depth", F.when(outside & (title != ""), F.length(F.regexp_extract("line", r"^\s*(#{1,6}) ", 1))))
    numbered = heads.withColumn("title", F.when(F.col("depth").isNotNull(), title)).withColumn("section", F.count("depth").over(upto))
    # the fence that a line lies in: odd counts are inside; it is closed if the file has the next one
    whole = Window.partitionBy(*by)
    numbered = numbered.withColumn("all_fences", F.max("fences").over(whole))
    inside = ~F.col("fence") & (F.col("fences") % 2 == 1) & (F.col("fences") < F.col("all_fences"))
    code = F.when(inside, F.struct(F.col("fences").alias("block"), F.col("i"), F.col("line")))
    body = F.when(F.col("depth").isNull(), F.struct("i", "line"))
    cut = numbered.groupBy(*by, "section").agg(
        F.max("title").alias("section_title"), F.max("depth").alias("depth"), (F.min("i") + 1).alias("first"), (F.max("i") + 1).alias("last"),
        F.array_sort(F.collect_list(body)).alias("body"), F.array_sort(F.collect_list(code)).alias("code"),
    )
    content = F.trim(F.array_join(F.transform("body", lambda x: x["line"]), "\n"), F.lit(" \n\t\r"))
    blocks = F.array_distinct(F.transform("code", lambda x: x["block"]))
    symbols = F.flatten(F.transform(blocks, lambda b: code_identifiers(F.array_join(F.transform(F.filter("code", lambda x: x["block"] == b), lambda x: x["line"]), "\n"))))
    made = cut.withColumn("content", content).withColumn("code_symbols", symbols)
    # the last heading of each depth so far; it stands above the section if no heading of a lesser depth came after it
    sofar = Window.partitionBy(*by).orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    made = made.withColumns({f"head{d}": F.last(F.when(F.col("depth") == d, F.struct("section", F.col("section_title").alias("title"))), ignorenulls=True).over(sofar) for d in range(1, 7)})
    levels = []
    for d in range(1, 7):
        above = F.greatest(F.lit(-1), *(F.coalesce(F.col(f"head{e}.section"), F.lit(-1)) for e in range(1, d)), F.lit(-1))
        levels.append(F.when((F.col("depth") >= d) & (F.col(f"head{d}.section") > above), F.col(f"head{d}.title")))
    made = made.withColumn("heading_hierarchy", F.array_compact(F.array(*levels)))
    kept = made.where(~_blank(F.col("content")) | (F.col("section_title").isNotNull() & (F.size("code_symbols") > 0)))
    own = kept.select(*by, F.coalesce("section_title", F.lit("Introduction")).alias("section_title"), "heading_hierarchy", "content", "code_symbols", F.col("first").cast("int").alias("start_line"), F.col("last").cast("int").alias("end_line"), "section")
    bare = files.where(F.col("content").rlike(r"\S")).join(kept.select(*by).distinct(), by, "left_anti")
    intro = bare.select(
        *by, F.lit("Introduction").alias("section_title"), F.array().cast("array<string>").alias("heading_hierarchy"), F.trim(F.regexp_replace("content", r"\r\n", "\n"), F.lit(" \n\t\r")).alias("content"),
        code_identifiers(F.col("content")).alias("code_symbols"), F.lit(1).alias("start_line"), F.size(F.split(F.regexp_replace("content", r"\r?\n\z", ""), "\n")).alias("end_line"), F.lit(0).cast("long").alias("section"),
    )
    every = own.unionByName(intro)
    return every.withColumn("ordinal", F.row_number().over(Window.partitionBy(*by).orderBy("section")) - 1).drop("section")
