"""Ranked search over an index: many queries in one plan, filters, and the best k of each."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.stemming import stem
from ..plans.lineage import written
from ..schemas import FIELD_WEIGHTS
from .index import Index

_K1, _B = 1.2, 0.75


@dataclass(frozen=True)
class Filters:
    """All given kinds must hold; of folders and of extensions any one."""

    dirs: list[str] = field(default_factory=list)
    exts: list[str] = field(default_factory=list)
    doc_type: str | None = None

    @classmethod
    def of(cls, dirs: list[str] = (), exts: list[str] = (), doc_type: str | None = None) -> "Filters":
        return cls(X.normal_dirs(list(dirs)), X.normal_extensions(list(exts)), doc_type)

    def condition(self) -> Column | None:
        parts = []
        if self.doc_type:
            parts.append(F.col("doc_type") == self.doc_type)
        if self.dirs:
            parts.append(_any([X.in_dir("filepath", d) for d in self.dirs]))
        if self.exts:
            parts.append(X.extension("filepath").isin(self.exts))
        return None if not parts else _all(parts)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _float(c) -> Column:
    return (F.lit(c) if isinstance(c, (int, float)) else c).cast("float")


def idf(df: Column, n: Column) -> Column:
    """ln(1 + (n - df + 0.5) / (df + 0.5)), worked out in double and kept as float."""
    return F.log1p((n.cast("double") - df.cast("double") + 0.5) / (df.cast("double") + 0.5)).cast("float")


def tf_norm(tf: Column, dl: Column, avgdl: Column) -> Column:
    """tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) in float; the product and sum are rounded once."""
    norm = _float(_float(1 - _B) + _float(_float(_float(_B) * _float(dl)) / avgdl))
    bottom = _float(_float(_K1).cast("double") * norm.cast("double") + tf.cast("double"))
    return F.when(avgdl > 0, _float(_float(_float(tf) * _float(_K1 + 1)) / bottom)).otherwise(_float(0.0))


def query_terms(queries: DataFrame, stemming: bool = True, identifiers: bool = False) -> DataFrame:
    """(query_id, qpos, term) of (query_id, query): words of a text, repeats kept.

    identifiers splits camel and snake case as well, which the index does for names only.
    """
    words = F.split(F.col("query"), X.WORD_BREAK)
    tokens = F.flatten(F.transform(words, X.identifier_tokens)) if identifiers else X.text_tokens(F.col("query"))
    tokens = X.stemmed(tokens) if stemming else tokens
    return queries.select("query_id", F.posexplode(tokens).alias("qpos", "term"))


#: Query terms that are sent to every task (beyond, they are joined by a shuffle), and different
#: ones that the scan of the postings is asked for by value.
BROADCAST_TERMS, PUSHED_TERMS = 500_000, 2_000


def _known(index: Index, terms: DataFrame) -> tuple[DataFrame, bool]:
    """(query terms with their df, whether they are few enough to be broadcast).

    Where the different terms are few, the frequencies are read by value, so that the scan skips
    the row groups without them.
    """
    terms = written(terms, "terms")
    size = terms.agg(F.count("*").alias("rows"), F.count_distinct("term").alias("terms")).first()
    few = size["rows"] <= BROADCAST_TERMS
    freqs = index.doc_freqs
    if size["terms"] <= PUSHED_TERMS:
        freqs = freqs.where(F.col("term").isin([r["term"] for r in terms.select("term").distinct().collect()]))
    return freqs.join(F.broadcast(terms) if few else terms.hint("shuffle_hash"), "term"), few


def _hits(index: Index, terms: DataFrame) -> DataFrame:
    """The postings of query terms.  Postings are never broadcast; beyond BROADCAST_TERMS they are
    shuffled, and a hot term's part is split by adaptive execution."""
    known, few = _known(index, terms)
    if not few:
        return index.postings.hint("merge").join(known, "term")
    known = written(known, "known")
    postings, found = index.postings, known.select("term").distinct().limit(PUSHED_TERMS + 1).collect()
    if len(found) <= PUSHED_TERMS:
        postings = postings.where(F.col("term").isin([r["term"] for r in found]))
    return postings.join(F.broadcast(known), "term")


def _within(hits: DataFrame, index: Index, filters: Filters) -> DataFrame:
    condition = filters.condition()
    return hits if condition is None else hits.join(index.doc_store.where(condition).select("doc_id"), "doc_id", "left_semi")


def _part(n: Column, df: Column, avgdl: Column, weights: tuple[float, ...]) -> Column:
    """What one posting adds to the score."""
    weight = F.coalesce(F.get(F.array(*map(_float, weights)), F.col("field_id").cast("int")), _float(0.0))
    return _float(_float(idf(df, n) * tf_norm(F.col("tf"), F.col("dl"), avgdl)) * weight)


def _summed(parts: DataFrame, *by: str) -> DataFrame:
    """Parts (qpos, field_id, s) add up in float in the order of query word and field, so equal
    documents get equal scores however the data are partitioned."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("qpos", "field_id", "s"))), lambda x: x["s"])
    return parts.groupBy(*by).agg(F.aggregate(ordered, _float(0.0), lambda a, x: _float(a + x)).alias("score"))


def scores(index: Index, terms: DataFrame, filters: Filters = Filters(), weights: tuple[float, ...] = FIELD_WEIGHTS) -> DataFrame:
    """(query_id, doc_id, score) of (query_id, qpos, term).  Filters take documents out, never change the statistics."""
    n, average = index.constants
    fields = F.create_map(*(x for k, v in average.items() for x in (F.lit(k), _float(v)))) if average else F.create_map().cast("map<int,float>")
    avgdl = F.coalesce(F.try_element_at(fields, F.col("field_id").cast("int")), _float(0.0))
    hits = _within(_hits(index, terms), index, filters)
    return _summed(hits.select("query_id", "doc_id", "qpos", "field_id", _part(F.lit(n), F.col("df"), avgdl, weights).alias("s")), "query_id", "doc_id")


def driver_terms(spark: SparkSession, query: str, stemming: bool = True) -> list[str]:
    """The words of one query, repeats kept: of an ASCII query at once, of others by the same expressions
    as those of a text; no job is run."""
    if query.isascii():
        words = [w for w in re.findall(r"[a-z0-9_]+", query.lower()) if 1 < len(w) < X.MAX_WORD_BYTES]
        return [stem(w) for w in words] if stemming else words
    words = spark.sql("select :query as query", args={"query": query}).select(X.text_tokens("query").alias("words")).first()["words"] or []
    return [stem(w) for w in words] if stemming else words


def best(scored: DataFrame, k: int, salts: int = 32) -> DataFrame:
    """The k best of each query with their rank from 1; ties go to the smaller doc_id.

    Two rounds: the best of each salt first, so that a query that hits a great part of the
    documents is not ranked in one task.
    """
    if k <= 0:
        return scored.where("false").withColumn("rank", F.lit(0))
    order = [F.desc("score"), F.asc("doc_id")]
    few = scored.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "_salt").orderBy(*order))).where(F.col("_r") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).drop("_salt", "_r")


#: Postings that are scored at once, in whole documents; and what a word's number is multiplied by to hold a field.
SCORED_ROWS, _FIELDS = 1 << 19, 128


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(doc_id, key, s) of about SCORED_ROWS postings each; the rows of a document stay together."""

    def joined(held):
        return tuple(np.concatenate([b[i] for b in held]) for i in range(3))

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "key", "s")))
            n += b.num_rows
        if n >= SCORED_ROWS:
            rows = joined(held)
            cut = np.flatnonzero(rows[0] != rows[0][-1])  # the last document may go on
            if cut.size:
                at = cut[-1] + 1
                yield tuple(x[:at] for x in rows)
                rows = tuple(x[at:] for x in rows)
            held, n = [rows], len(rows[0])
    if n:
        yield joined(held)


def _best_of_rows(words: np.ndarray, ends: np.ndarray, k: int):
    """The function that turns postings (doc_id, key, s) into the k best (number, doc_id, score) of each query
    among them.  Query i asks for words[ends[i - 1]:ends[i]] in this order; key is word * _FIELDS + field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [q.tolist() for q in np.split(words, ends[:-1])]
        docs = [np.empty(0, np.int64)] * len(asked)
        best = [np.empty(0, np.float32)] * len(asked)
        least = [-np.inf] * len(asked)  # what a document needs at least
        for doc_id, key, s in _whole(batches):
            new = np.concatenate([[True], doc_id[1:] != doc_id[:-1]])
            ids, at = doc_id[new], np.cumsum(new) - 1
            order, kinds = np.argsort(key, kind="stable"), len(np.unique(key % _FIELDS))
            at, s, word = at[order], s[order], key[order] // _FIELDS
            cuts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            parts = {w: (at[a:b], s[a:b]) for w, a, b in zip(word[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(word)])}
            total = np.zeros(len(ids), np.float32)
            for i, q in enumerate(asked):
                mine = [parts[w] for w in q if w in parts]
                if not mine:
                    continue
                for where, what in mine:
                    np.add.at(total, where, what)  # one after the other: by word, then by field
                hit = mine[0][0] if len(mine) == 1 else np.concatenate([where for where, _ in mine])
                found, some = total[hit], k * len(mine) * kinds
                bound = least[i]
                if len(found) > some:  # a document is here once for each word and field at most, so k of them have this much
                    bound = max(bound, np.partition(found, -some)[-some])
                chosen = np.unique(hit[found >= bound])
                if chosen.size:
                    score, doc = np.concatenate([best[i], total[chosen]]), np.concatenate([docs[i], ids[chosen]])
                    top = np.lexsort((doc, -score))[:k]
                    best[i], docs[i] = score[top], doc[top]
                    if len(top) == k:
                        least[i] = best[i][-1]
                total[hit] = 0
        numbers = np.repeat(np.arange(len(asked), dtype=np.int64), [len(d) for d in docs])
        yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(np.concatenate([*docs, np.empty(0, np.int64)])), pa.array(np.concatenate([*best, np.empty(0, np.float32)]))], ["number", "doc_id", "score"])

    return run


def _best_of_block(index: Index, terms: DataFrame, k: int, filters: Filters, weights: tuple[float, ...]) -> DataFrame:
    """The k best of queries whose terms the driver may hold.

    Documents, not queries, are dealt out: each task scores all queries over its documents and passes on the k
    best of each, so of the hits, which grow with queries times documents, none is shuffled.  Queries of the same
    words are answered once.
    """
    spark: SparkSession = index.postings.sparkSession
    asked = terms.toArrow().sort_by([("query_id", "ascending"), ("qpos", "ascending")])
    wanted = asked["term"].unique().to_pylist()
    if len(wanted) <= PUSHED_TERMS:
        freqs = index.doc_freqs.where(F.col("term").isin(wanted))
    else:
        freqs = index.doc_freqs.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    known = freqs.select("term", "df").toArrow().combine_chunks()
    known = known.append_column("word", pa.array(range(known.num_rows), pa.int32()))
    word_of = dict(zip(known["term"].to_pylist(), known["word"].to_pylist()))
    of: dict[object, list[int]] = {}
    for query, term in zip(asked["query_id"].to_pylist(), asked["term"].to_pylist()):
        if term in word_of:
            of.setdefault(query, []).append(word_of[term])
    number: dict[tuple[int, ...], int] = {}
    queries = [(query, number.setdefault(tuple(q), len(number))) for query, q in of.items()]
    kinds = terms.select("query_id").withColumn("number", F.lit(0).cast("long")).schema
    words, ends = np.array([w for q in number for w in q], np.int32), np.cumsum([len(q) for q in number], dtype=np.int64)
    n, average = index.constants
    avgdl = F.coalesce(F.try_element_at(F.create_map(*(x for f, v in average.items() for x in (F.lit(f), _float(v)))) if average else F.create_map().cast("map<int,float>"), F.col("field_id").cast("int")), _float(0.0))
    postings = index.postings
    if len(word_of) <= PUSHED_TERMS:
        postings = postings.where(F.col("term").isin(list(word_of)))
    hits = _within(postings.join(F.broadcast(spark.createDataFrame(known, "term string, df long, word int")), "term"), index, filters)
    hits = hits.select("doc_id", (F.col("word").cast("long") * _FIELDS + F.col("field_id")).alias("key"), _part(F.lit(n), F.col("df"), avgdl, weights).alias("s"))
    if not index.together or filters.condition() is not None:
        hits = hits.repartition("doc_id").sortWithinPartitions("doc_id")
    few = hits.mapInArrow(_best_of_rows(words, ends, k), "number long, doc_id long, score float")
    top = few.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.asc("doc_id")))).where(F.col("rank") <= k)
    return top.join(F.broadcast(spark.createDataFrame(queries, kinds)), "number").select("query_id", "doc_id", "score", "rank")


def best_of_many(index: Index, terms: DataFrame, k: int, filters: Filters = Filters(), weights: tuple[float, ...] = FIELD_WEIGHTS) -> DataFrame:
    """(query_id, doc_id, score, rank): best() of scores(), in blocks of about BROADCAST_TERMS query terms."""
    if k <= 0:
        return best(scores(index, terms, filters, weights), k)
    terms = written(terms, "terms")
    blocks = max(1, -(-terms.count() // BROADCAST_TERMS))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return reduce(DataFrame.unionByName, (_best_of_block(index, terms.where(block == b), k, filters, weights) for b in range(blocks)))


def search_many(index: Index, queries: DataFrame, k: int = 10, filters: Filters = Filters(), stemming: bool = True, weights: tuple[float, ...] = FIELD_WEIGHTS) -> DataFrame:
    """The k best documents of each (query_id, query), with the columns of the document store."""
    return best_of_many(index, query_terms(queries, stemming), k, filters, weights).join(index.doc_store, "doc_id")


def search(index: Index, query: str, k: int = 10, filters: Filters = Filters(), stemming: bool = True, weights: tuple[float, ...] = FIELD_WEIGHTS) -> DataFrame:
    """The k best documents of one query, best first; none for k of 0 or a query without words.

    The words are known to the driver, so postings and frequencies are read by value; the
    constants of an index are read once.
    """
    spark: SparkSession = index.postings.sparkSession
    terms = driver_terms(spark, query, stemming)
    nothing = index.doc_store.where("false").select("doc_id", _float(0.0).alias("score"), *(c for c in index.doc_store.columns if c != "doc_id"))
    if not terms or k <= 0:
        return nothing
    n, average = index.constants
    wanted = F.col("term").isin(sorted(set(terms)))
    df = {r["term"]: r["df"] for r in index.doc_freqs.where(wanted).collect()}
    places = {t: [i for i, x in enumerate(terms) if x == t] for t in df}
    if not df or not average:
        return nothing
    table = F.create_map(*(x for t in df for x in (F.lit(t), F.struct(F.array(*map(F.lit, places[t])).alias("qpos"), F.lit(df[t]).cast("long").alias("df")))))
    fields = F.create_map(*(x for f, v in average.items() for x in (F.lit(f), _float(v))))
    avgdl = F.coalesce(F.try_element_at(fields, F.col("field_id").cast("int")), _float(0.0))
    hits = _within(index.postings.where(F.col("term").isin(sorted(df))), index, filters).withColumn("q", F.try_element_at(table, F.col("term")))
    parts = hits.select("doc_id", F.explode("q.qpos").alias("qpos"), "field_id", _part(F.lit(n), F.col("q.df"), avgdl, weights).alias("s"))
    top = _summed(parts, "doc_id").orderBy(F.desc("score"), "doc_id").limit(k)
    # once more the first k, so that the order needs no ranges
    return (F.broadcast(top) if k <= BROADCAST_TERMS else top).join(index.doc_store, "doc_id").orderBy(F.desc("score"), "doc_id").limit(k)
