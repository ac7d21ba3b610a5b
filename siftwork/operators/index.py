"""The four-field inverted index as tables: postings, document frequencies, field statistics, documents."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..plans.lineage import written


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # term, doc_id, field_id, tf, dl (length of the field in the document)
    doc_freqs: DataFrame  # term, df
    field_stats: DataFrame  # field_id, total_length, doc_count
    doc_store: DataFrame  # see schemas.DOC_STORE
    total_docs: DataFrame  # one row: n
    together: bool = False  # whether one task reads the postings of a document one after the other

    @cached_property
    def constants(self) -> tuple[int, dict[int, float]]:
        """(number of documents, average length of each field): five numbers, read once for an index."""
        rows = self.field_stats.select(F.col("field_id").cast("int").alias("field_id"), average_length().alias("avgdl")).collect()
        return self.total_docs.first()["n"], {r["field_id"]: r["avgdl"] for r in sorted(rows)}

    def save(self, folder: str, files: int | None = None) -> None:
        """Parquet, postings and frequencies in order of terms, so that a query reads few row groups."""
        for name in ("postings", "doc_freqs"):
            df = getattr(self, name)
            ranged = df.repartitionByRange(files, "term") if files else df.repartitionByRange("term")
            order = ["term", "doc_id", "field_id"] if name == "postings" else ["term"]
            # a bloom filter and small row groups let a scan skip what a query does not ask for
            ranged.sortWithinPartitions(*order).write.mode("overwrite").option("parquet.bloom.filter.enabled#term", True).option("parquet.block.size", 16 * 1024**2).parquet(f"{folder}/{name}")
        for name in ("field_stats", "doc_store", "total_docs"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> "Index":
        return cls(*(spark.read.parquet(f"{folder}/{n}") for n in ("postings", "doc_freqs", "field_stats", "doc_store", "total_docs")))


def numbered(df: DataFrame, *keys: str, name: str = "doc_id") -> DataFrame:
    """Running numbers from 0 in the order of the keys, without sorting in one task.

    Range partitions are written once; each is numbered by itself from the sum of the rows before it.
    """
    parts = written(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    return parts.withColumn("_place", place).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def _tokens_of(strings: str, tokens) -> Column:
    """The tokens of an array of strings; null strings have none."""
    return F.flatten(F.transform(F.filter(strings, lambda x: x.isNotNull()), tokens))


def code_documents(symbols: DataFrame) -> DataFrame:
    """Symbols with a doc_id as documents: display columns and the four fields."""
    fields = F.array(
        X.identifier_tokens("name"),
        F.coalesce(X.text_tokens(X.searchable_comment(F.col("comment"))), F.array().cast("array<string>")),
        F.coalesce(_tokens_of("params", X.identifier_tokens), F.array().cast("array<string>")),
        X.identifier_tokens("filepath"),
    )
    return symbols.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit("Code").alias("doc_type"), "filepath", "name", "kind", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"),
        X.is_example_path("filepath").alias("is_example"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("snippet"), fields.alias("fields"),
    )


def doc_documents(sections: DataFrame) -> DataFrame:
    """Sections with a doc_id as documents; the title stands in the hierarchy too and so counts twice."""
    none = F.array().cast("array<string>")
    fields = F.array(
        F.concat(F.coalesce(X.text_tokens("section_title"), none), F.coalesce(_tokens_of("heading_hierarchy", X.text_tokens), none)),
        F.coalesce(X.text_tokens("content"), none),
        F.coalesce(_tokens_of("code_symbols", X.identifier_tokens), none),
        X.identifier_tokens("filepath"),
    )
    return sections.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit("Doc").alias("doc_type"), "filepath", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("kind"), F.col("start_line").cast("int").alias("start_line"),
        F.col("end_line").cast("int").alias("end_line"), X.is_example_path("filepath").alias("is_example"), F.col("section_title").alias("section"), F.left("content", F.lit(200)).alias("snippet"), fields.alias("fields"),
    )


def build(documents: DataFrame, stemming: bool = True, stored: bool = True) -> Index:
    """The index of documents made by code_documents and doc_documents, one row for each doc_id.

    With stored, the counted terms are written to the shared folder once, a row for each document, and all
    else is read from them; without, every table is a plan of its own.

    Terms are counted within the rows, so postings are never shuffled; frequencies and lengths are partial
    sums.  A null field counts as empty.
    """
    counts = documents.select("doc_id", (X.stem_counts if stemming else X.term_counts)("fields").alias("fields"))
    if stored:
        counts = written(counts, "postings")
    one = counts.select("doc_id", F.posexplode("fields").alias("field_id", "field")).where("field is not null")
    postings = one.select("doc_id", F.col("field_id").cast("byte").alias("field_id"), F.col("field.dl").alias("dl"), F.inline("field.terms")).select("term", "doc_id", "field_id", "tf", "dl")
    freqs = counts.select(F.explode(F.array_distinct(F.flatten(F.transform(F.filter("fields", lambda f: f.isNotNull()), lambda f: f["terms"]["term"])))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    stats = one.select(F.col("field_id").cast("byte").alias("field_id"), "field.dl").groupBy("field_id").agg(F.sum("dl").cast("long").alias("total_length"), F.count_if(F.col("dl") > 0).alias("doc_count"))
    return Index(postings, freqs, stats, documents.drop("fields"), counts.agg(F.count("*").alias("n")), together=stored)


def average_length() -> Column:
    """Over the documents in which the field is not empty; 0 if there are none."""
    return F.when(F.col("doc_count") > 0, (F.col("total_length").cast("float") / F.col("doc_count").cast("float")).cast("float")).otherwise(F.lit(0.0).cast("float"))
