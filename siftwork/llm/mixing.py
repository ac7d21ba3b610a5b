"""Problem 7: mixing sources to target weights.

The size of a record is its number of tokens under a public tokenizer.  The mixture is
made of equal-token blocks, which Sainte-Laguë apportionment awards to the sources one by
one by highest quotient; runs of awards make the shards, so each shard has whole-number
quotas.  A source's records stand in a seeded order, repeated max_repeats times at most;
its blocks cut that stream, and each block (the records whose middle lies in it) goes to
the shard that was awarded it.

Places in a source's order are prefix sums in two steps (sums of hash buckets, then within a
bucket), so a source may hold any share of all records.  Only the table of sources (checked
to be small) and the awards (their number is a parameter) pass through the driver.

The size of the mixture is that of total_tokens:

* None: the largest at which all but the share SHORT of the wanted mixture can be had.  A source that
  cannot fill its part is used as often as it may be, and its shortfall is reported; the others keep
  their parts of the whole, so the mixture is smaller by the shortfalls.
* 'strict': the largest at which every source that has records reaches its share; one small source
  can make it small.
* 'all', or a number: the tokens of all records of listed sources, or so many.  Blocks that a source
  cannot fill go to the others.

A block holds at least the largest record.  Sources without records get nothing.

Defined results: source names are compared trimmed and in lower case; null sources,
sources that are not listed, and null or empty texts take no part; a record delivered
more than once is one record; of several weights for a source the largest counts; a
null weight, one of 0 or less, or a max_repeats below 1 leaves the source out.
"""

from __future__ import annotations

import heapq
import math
import os
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SEATS, SHARDS, SEED = 10_000, 16, 20240
#: The part of the wanted mixture whose sources may be too small for it.
SHORT = 0.2
#: Tokens of a hash bucket, within which one task orders the records; and most sources.
BUCKET_TOKENS, MAX_SOURCES = 20_000_000, 100_000

# Fixed value: the pattern that splits text before the merges of the vocabulary.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoders: dict = {}


def _encoder(name: str):
    """The tokenizer of a vocabulary file that was sent to the executors."""
    if name not in _encoders:
        import base64

        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[name] = tiktoken.Encoding(name, pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[name]


def _source(name: str = "source") -> Column:
    return F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))


def sized(documents: DataFrame, weights: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens): the records of listed sources with their sizes.

    Repeated rows are dropped by their sizes, not before, so that no text is shuffled.
    """
    listed = weights.select("source").distinct()
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _source().alias("source"), "text").where("doc_id is not null and text <> ''").join(listed, "source", "left_semi")

    documents.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def count(batches):
        encode = _encoder(name).encode_ordinary
        for b in batches:
            n = [len(encode(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    return docs.select("doc_id", "source", "text").mapInArrow(count, "doc_id bigint, source string, tokens bigint").dropDuplicates(["doc_id"])


@dataclass(frozen=True)
class Plan:
    total: float  # tokens that are wanted
    block: float  # tokens of a block
    awards: list[tuple[str, int, int]]  # (source, its nth block, shard)
    quotas: dict[str, int]
    wanted: dict[str, float]  # tokens of the quota, as far as the source has them


def total_size(limits: dict[str, float], shares: dict[str, float], short: float) -> float:
    """The largest total at which at most the share short of the wanted mixture is of sources that
    cannot fill their part; limits has the total up to which each can."""
    left, small = short * sum(shares.values()) + 1e-12, 0.0
    for s in sorted(limits, key=lambda s: (limits[s], s)):
        small += shares[s]
        if small > left:
            return limits[s]
    return max(limits.values())


def apportion(sizes: dict[str, int], shares: dict[str, float], repeats: dict[str, int], total: float | str | None = None, seats: int = SEATS, shards: int = SHARDS, least: float = 0.0) -> Plan:
    """Awards blocks of at least so many tokens by Sainte-Laguë quotients share / (2 n + 1); ties go to the larger share, then by name."""
    live = {s: shares[s] for s in shares if sizes.get(s, 0) > 0}
    whole = sum(live.values())
    if not live or seats < 1:
        return Plan(0.0, 0.0, [], {}, {})
    limits = {s: sizes[s] * repeats[s] * whole / live[s] for s in live}
    pass_on = total is not None
    if total in (None, "strict"):
        total = total_size(limits, live, 0.0 if total == "strict" else SHORT)
    elif total == "all":
        total = float(sum(sizes[s] for s in live))
    if least > 0:
        seats = max(1, min(seats, int(total / least)))
    block = total / seats
    quotas = dict.fromkeys(live, 0)
    most = {s: math.ceil(sizes[s] * repeats[s] / block - 1e-9) for s in live}
    heap = [(-live[s], -live[s], 0, s) for s in live]
    heapq.heapify(heap)
    awards, seat = [], 0
    while heap and seat < seats:
        _, share, n, s = heapq.heappop(heap)
        if n < most[s]:
            awards.append((s, n, seat * shards // seats))
            quotas[s] += 1
        elif pass_on:
            continue
        seat += 1
        heapq.heappush(heap, (share / (2 * n + 3), share, n + 1, s))
    return Plan(total, block, awards, quotas, {s: min(quotas[s] * block, float(sizes[s] * repeats[s])) for s in live})


def _weights(weights: DataFrame) -> DataFrame:
    ok = weights.select(_source().alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("repeats"))
    return ok.where("source is not null and share > 0 and repeats >= 1").groupBy("source").agg(F.max(F.struct("share", "repeats")).alias("w")).select("source", "w.share", "w.repeats")


@dataclass(frozen=True)
class Mixture:
    records: DataFrame  # shard, doc_id, source, copy (from 1), tokens
    report: DataFrame


def mix(documents: DataFrame, weights: DataFrame, total_tokens: float | str | None = None, seats: int = SEATS, shards: int = SHARDS, seed: int = SEED, tokenizer: str = TOKENIZER) -> Mixture:
    """The mixture and its report; total_tokens is None, 'strict', 'all' or a number of tokens, see above."""
    spark = documents.sparkSession
    w = _weights(weights)
    rows = w.orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    docs = written(sized(documents, w, tokenizer), "sized").where("tokens > 0")
    held = docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest")).collect()
    sizes = {r["source"]: r["tokens"] for r in held}
    shares = {r["source"]: r["share"] for r in rows}
    plan = apportion(sizes, shares, {r["source"]: r["repeats"] for r in rows}, total_tokens, seats, shards, max((r["largest"] for r in held), default=0))

    whole = sum(shares[s] for s in plan.quotas) or 1.0
    source_table = spark.createDataFrame([(s, float(sizes[s]), q, plan.wanted[s], shares[s] / whole * plan.total) for s, q in plan.quotas.items()], "source string, size double, quota int, wanted double, target_tokens double")
    award_table = spark.createDataFrame(plan.awards, "source string, nth int, shard int")
    buckets = max(8, -(-sum(sizes.values()) // BUCKET_TOKENS))
    placed = docs.withColumn("order", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.pmod(F.shiftright("order", 20), F.lit(buckets)))
    sums = placed.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("source", "bucket", before.alias("offset"))
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = placed.withColumn("inside", inside).join(offsets, ["source", "bucket"]).withColumn("place", F.col("offset") + F.col("inside") + F.col("tokens") / 2).join(F.broadcast(source_table), "source")
    block = F.lit(plan.block or 1.0)
    copies = F.floor((F.col("wanted") - F.col("place")) / F.col("size") - 1e-12).cast("int")  # further ones
    used = at.where(F.col("place") < F.col("wanted")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(copies, F.lit(0)))))
    nth = F.least(F.floor((F.col("copy") * F.col("size") + F.col("place")) / block), F.col("quota") - 1).cast("int")
    records = used.withColumn("nth", nth).join(F.broadcast(award_table), ["source", "nth"]).select("shard", "doc_id", "source", (F.col("copy") + 1).alias("copy"), "tokens")

    got = records.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("copy").alias("most_copies"), F.count_distinct("doc_id").alias("records_used"))
    one = F.lit(1).alias("one")
    every = got.agg(F.sum("tokens").alias("all_tokens")).select("all_tokens", one)
    report = (
        w.join(F.broadcast(source_table.select("source", "quota", "target_tokens")), "source", "left")
        .join(docs.groupBy("source").agg(F.count("*").alias("records"), F.sum("tokens").alias("available_tokens")), "source", "left")
        .join(got, "source", "left")
        .withColumn("one", one)
        .join(F.broadcast(every), "one")
        .select(
            "source", F.col("share").alias("target_share"), F.col("repeats").alias("max_repeats"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"),
            F.coalesce("quota", F.lit(0)).alias("blocks"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("records_used", F.lit(0)).alias("records_used"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), F.round(F.coalesce("target_tokens", F.lit(0.0)), 3).alias("target_tokens"),
            F.round(F.greatest(F.coalesce("target_tokens", F.lit(0.0)) - F.coalesce("tokens", F.lit(0)), F.lit(0.0)), 3).alias("shortfall_tokens"),
        )
    )
    return Mixture(records, report)
