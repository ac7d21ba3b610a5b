"""Problem 2: how often every term or n-gram occurs, and in how many records.

Suffix-sorted counting: every position gives a suffix, cut to sigma terms; suffixes are
routed to a task by their first term, sorted there in reverse lexicographic order, and one
pass with a stack counts every prefix, as an extension always comes before its prefix.
An inverted index has no positions, so its terms are suffixes of length one that weigh tf.

A term may hold any share of the rows: the route is (first term, salt of the record), so a
hot term is spread over as many tasks as there are salts, and no task keeps more than one
salt's records.  The partial counts of the salts add up, as each record has one salt.  A row is
shuffled once and not aggregated before: rows of one suffix and record meet in the sorted task,
where equal ones are dropped and the others added up, a batch at a time.

Defined results: null terms, records and weights do not count; repeated rows (where asked)
count once; terms are compared after NFC, trimming and lower-casing; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Records a task may have to remember for one prefix.
RECORDS_PER_SALT = 200_000


# Fixed value: the white space among ASCII characters.
_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"


def _normalise(batches):
    """plain becomes the NFC, trimmed and in lower case, of term; each different value of a batch is worked out once."""
    for b in batches:
        coded = b.column("term").dictionary_encode()
        values = [unicodedata.normalize("NFC", v).strip().lower() for v in coded.dictionary.to_pylist()]
        plain = pa.array(values, pa.string()).take(coded.indices)
        yield pa.RecordBatch.from_arrays([plain if n == "plain" else b.column(n) for n in b.schema.names], b.schema.names)


def normalised(rows: DataFrame, term: str = "term") -> DataFrame:
    """The rows with a column plain: the term after NFC, trimmed, in lower case.  Only terms with
    characters outside ASCII go to Python."""
    rows = rows.withColumn("plain", F.lower(F.trim(term, F.lit(_BLANKS))))
    ascii = F.octet_length(term) == F.length(term)
    return rows.where(ascii).unionByName(rows.where(~ascii).mapInArrow(_normalise, rows.schema))


class _Stack:
    """The suffix that is being counted, and for each of its prefixes the occurrences and the records so far."""

    def __init__(self):
        self.terms: list[str] = []
        self.counts: list[int] = []
        self.records: list[list[np.ndarray]] = []
        self.out: tuple[list, list, list] = ([], [], [])

    def pop(self, depth: int) -> None:
        """Gives out the prefixes beyond a depth; what they hold goes on to the one before."""
        while len(self.terms) > depth:
            n, parts = self.counts.pop(), self.records.pop()
            records = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            for column, value in zip(self.out, (list(self.terms), n, len(records))):
                column.append(value)
            self.terms.pop()
            if self.terms:
                self.counts[-1] += n
                self.add(records)

    def add(self, records: np.ndarray) -> None:
        """Records of the top; put together before they take twice the room."""
        parts = self.records[-1]
        parts.append(records)
        if len(parts) > 64 and sum(map(len, parts[1:])) > len(parts[0]):
            parts[:] = [np.unique(np.concatenate(parts))]

    def count(self, suffix: list[str], n: int, records: np.ndarray) -> None:
        terms, same = self.terms, 0
        while same < len(terms) and same < len(suffix) and terms[same] == suffix[same]:
            same += 1
        self.pop(same)
        while len(terms) < len(suffix):
            terms.append(suffix[len(terms)])
            self.counts.append(0)
            self.records.append([])
        self.counts[-1] += n
        self.add(records)

    def batch(self) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(self.out[0], pa.list_(pa.string())), pa.array(self.out[1], pa.int64()), pa.array(self.out[2], pa.int64())], ["gram", "occurrences", "records"])
        for x in self.out:
            x.clear()
        return made


def _changes(column: np.ndarray, before) -> np.ndarray:
    """Where a value differs from the one before it."""
    out = np.empty(len(column), bool)
    out[1:] = column[1:] != column[:-1]
    out[0] = before is None or column[0] != before
    return out


def _count(batches):
    """Rows (suffix, record, weight, delivery) in reverse lexicographic order of suffixes, then by record and
    delivery, to (gram, occurrences, records).  A row with the delivery of the one before it does not
    count; null deliveries are never the same."""
    stack, last = _Stack(), (None, None, None)
    for b in batches:
        if not b.num_rows:
            continue
        suffix = b.column("suffix")
        coded, lengths = suffix.flatten().dictionary_encode(), pc.list_value_length(suffix).to_numpy(zero_copy_only=False).astype(np.int64)
        words = coded.dictionary.to_pylist()
        first = np.cumsum(lengths) - lengths
        terms = np.full((len(lengths), int(lengths.max())), -1, np.int64)
        terms[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(coded)) - np.repeat(first, lengths)] = coded.indices.to_numpy(zero_copy_only=False)

        def text(i: int) -> list[str]:
            return [words[c] for c in terms[i, : lengths[i]]]

        record, weight = (b.column(c).to_numpy(zero_copy_only=False) for c in ("record", "weight"))
        delivery = b.column("delivery")
        known = delivery.is_valid().to_numpy(zero_copy_only=False)
        delivery = delivery.fill_null(0).to_numpy(zero_copy_only=False)
        new = np.ones(len(lengths), bool)
        new[1:] = (terms[1:] != terms[:-1]).any(1)
        new[0] = last[0] != text(0)
        fresh = new | _changes(record, last[1])
        again = known & ~fresh & ~_changes(delivery, last[2])
        starts = np.nonzero(new | (np.arange(len(new)) == 0))[0]
        sums = np.add.reduceat(np.where(again, 0, weight), starts)
        ends = np.append(starts[1:], len(new))
        done = slice(0, 0)
        if terms.shape[1] == 1 and len(stack.terms) <= 1 and len(starts) > 2:  # each of these goes on and off the stack at once
            done = slice(1, len(starts) - 1)
        for k in (0, *range(max(1, done.stop), len(starts))):
            if k == max(1, done.stop) and done.stop:
                stack.pop(0)
                stack.out[0].extend([words[c]] for c in terms[starts[done], 0].tolist())
                stack.out[1].extend(sums[done].tolist())
                stack.out[2].extend(np.add.reduceat(fresh.astype(np.int64), starts)[done].tolist())
            s, e = starts[k], ends[k]
            stack.count(text(s), int(sums[k]), record[s:e][fresh[s:e]])
        last = text(len(new) - 1), record[-1], delivery[-1] if known[-1] else None
        if len(stack.out[0]) > 20_000:
            yield stack.batch()
    stack.pop(0)
    yield stack.batch()


def suffix_counts(suffixes: DataFrame, salts: int, tasks: int | None = None, delivery: Column | None = None) -> DataFrame:
    """(gram array<string>, occurrences, records) from (suffix array<string>, record bigint, weight bigint).

    With delivery, a number of each row, rows that agree in suffix, record and delivery are one
    row delivered again and count once.
    """
    number = F.lit(None).cast("long") if delivery is None else delivery
    rows = suffixes.select("suffix", "record", "weight", number.alias("delivery"))
    # a number that is given is kept: small shuffles would else be read by a task or two, and Python is the slow part
    tasks = tasks or int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = rows.repartition(tasks, F.col("suffix")[0], F.pmod(F.xxhash64("record"), F.lit(salts)))
    ordered = routed.sortWithinPartitions(F.desc(F.col("suffix")[0]), F.desc("suffix"), "record", "delivery")
    parts = ordered.mapInArrow(_count, "gram array<string>, occurrences bigint, records bigint")
    return parts.groupBy("gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def _salts(records: int) -> int:
    return max(4, -(-records // RECORDS_PER_SALT))


def ngrams(texts: DataFrame, record: str, tokens: str, sigma: int) -> DataFrame:
    """Counts of every n-gram of up to sigma terms in an array column of terms."""
    if sigma < 1:
        raise ValueError("sigma must be at least 1")
    base = texts.select(F.col(record).cast("long").alias("record"), F.expr(f"filter({tokens}, t -> t is not null)").alias("tokens")).where("record is not null and size(tokens) > 0")
    n = base.select("record").distinct().count()
    at = base.select("record", "tokens", F.explode(F.sequence(F.lit(1), F.size("tokens"))).alias("i"))
    return suffix_counts(at.select(F.slice("tokens", F.col("i"), F.lit(sigma)).alias("suffix"), "record", F.lit(1).cast("long").alias("weight")), _salts(n))


def term_frequencies(postings: DataFrame, rare: int = 3, common: float = 0.3) -> DataFrame:
    """(term, occurrences, records, mark) over an inverted index with repeated rows.

    Repeated rows are told by a 64-bit hash of all their columns, compared only among the rows
    of one term and record.

    mark is 'rare' if all tf add up to at most rare, else 'common' if at least the share common of
    all distinct doc_id holds the term, else null.
    """
    total = postings.agg(F.count_distinct("doc_id").alias("total"))
    n = total.first()["total"]
    rows = postings.where("term is not null and doc_id is not null and tf is not null")
    rows = rows.select(F.col("doc_id").cast("long").alias("record"), F.col("tf").cast("long").alias("weight"), "term", F.xxhash64("build_id", "field_id", "segment_no", "tf", "term").alias("delivery"))
    suffixes = normalised(rows).select(F.array("plain").alias("suffix"), "record", "weight", "delivery")
    counts = suffix_counts(suffixes, _salts(n), delivery=F.col("delivery"))
    mark = F.when(F.col("occurrences") <= rare, "rare").when(F.col("records") >= F.lit(common) * F.lit(n), "common")
    return counts.select(F.col("gram")[0].alias("term"), "occurrences", "records", mark.alias("mark"))
