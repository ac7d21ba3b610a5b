"""An index that follows a stream of documents (an extension beyond the batch index).

Each micro-batch is written as the tables of an index of its own, under its number, so a
batch that is repeated after a failure overwrites itself.  Reading puts the batches together:
of a document that came more than once the last batch counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators.index import Index, build, doc_documents


def follow(sections: DataFrame, folder: str, stemming: bool = True, once: bool = True) -> StreamingQuery:
    """Starts indexing a stream of sections with a doc_id; with once it stops when all that is there is done."""

    def add(batch: DataFrame, number: int) -> None:
        one = build(doc_documents(batch.dropDuplicates(["doc_id"])), stemming)
        for name in ("postings", "doc_store"):
            getattr(one, name).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    writer = sections.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, folder: str) -> Index:
    """The index over all batches so far."""
    store = spark.read.parquet(f"{folder}/doc_store")
    last = store.select("doc_id", "batch").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("batch")))).where("_r = 1").select("doc_id", "batch")
    postings = spark.read.parquet(f"{folder}/postings").join(last, ["doc_id", "batch"]).select("term", "doc_id", "field_id", "tf", "dl")
    docs = store.join(last, ["doc_id", "batch"]).drop("batch")
    freqs = postings.groupBy("term", "doc_id").agg(F.lit(1)).groupBy("term").agg(F.count("*").alias("df"))
    lengths = postings.select("doc_id", "field_id", "dl").distinct()
    stats = lengths.groupBy("field_id").agg(F.sum("dl").cast("long").alias("total_length"), F.count("*").alias("doc_count"))
    return Index(postings, freqs, stats, docs, docs.agg(F.count("*").alias("n")))
