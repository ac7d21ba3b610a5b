"""Problem 6: evaluation items that leaked into documents.

Items are taken in blocks whose words are bounded, so what is broadcast never grows with the
corpus.  For a block, one pass over the documents counts in how many of them each n-gram of
the items occurs; the rare ones of an item become its seeds.  A second pass joins documents
to items by seeds, or whatever the counts where the n-grams that both have lie over enough of
the item for the wanted share, and aligns each pair at once by Smith-Waterman over words, passage by
passage, until no passage is left that is long enough.  A pair leaks if the passages
together hold the wanted share of the item's own words.  Nothing but counts is shuffled.

A passage has an n-gram in the item's wording: only the words of the item near one that both
have, and of the document near one, are aligned, so a long document costs what its hits do.

An item's own words are those after its stock instruction: the opening sentences that it
shares with other items.

Defined results: null and blank texts and items without own words of n-gram length give
nothing; an item of FEW words or less leaks only as a whole; repeated rows count once; an
empty table on either side gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the items in a block; an item is never split.
BLOCK_WORDS = 2_000_000
N = 3
SHARE = 0.4
#: A gram is rare if at most this share of the documents has it, and not too many items do.
RARE_SHARE, RARE_ITEMS = 0.002, 2
MIN_SEEDS = 3
#: How far from an n-gram that both have words of the item may be matched: without seeds, and with.
REACH, SEEDED_REACH = 4, 8
#: Smith-Waterman: scores of equal and unequal words and of a gap.
MATCH, MISMATCH, GAP = 2, -3, -2
#: Words that a passage must match: so many, or half of the wanted share of a short item, but an
#: n-gram at least.  And words that are no more than a phrase, if the item is longer.
MIN_MATCHED, FEW = 8, 4
#: The score at which the search for passages ends: that of MIN_SEEDS n-grams in a row, or of the
#: shortest passage, so that of edited passages the words count and not the score.
FLOOR = MATCH * (MIN_SEEDS + N - 1)
#: Words of a document that are aligned at once.
PIECE = 50_000

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?:])\s+|\n+")


def words(text: str) -> list[str]:
    """Words in compared form: without case, punctuation, layout and compatibility forms."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text.lower())


def own_words(items: DataFrame, shared_by: int = 3) -> DataFrame:
    """(item_id, words): the words of each item after its stock instruction.

    An opening sentence is stock if at least shared_by items have it at that place.
    """
    parts = F.filter(F.split(F.regexp_replace("text", r"([.!?:])\s+|\n+", "$1\n"), "\n"), lambda s: F.trim(s) != "")
    once = items.where("text is not null").select("item_id", "text").dropDuplicates(["item_id"]).select("item_id", parts.alias("parts"))
    heads = once.select("item_id", F.posexplode(F.slice("parts", 1, 3)).alias("i", "s")).withColumn("s", F.lower(F.trim("s")))
    stock = heads.groupBy("i", "s").agg(F.count("*").alias("n")).where(F.col("n") >= shared_by).select("i", "s", F.lit(True).alias("stock"))
    run = heads.join(stock, ["i", "s"], "left").groupBy("item_id").agg(F.min(F.when(F.col("stock").isNull(), F.col("i"))).alias("first"), F.count("*").alias("heads"))
    rest = once.join(run, "item_id", "left").withColumn("first", F.coalesce("first", "heads", F.lit(0)))
    return rest.select("item_id", F.array_join(F.slice("parts", F.col("first") + 1, F.greatest(F.size("parts"), F.lit(1))), "\n").alias("text"))


def least_passage(length: int, share: float = SHARE) -> int:
    """The words that a passage of an item must match."""
    return min(MIN_MATCHED, max(N, math.ceil(share * length / 2)))


def align(item: np.ndarray, doc: np.ndarray, least: int = MIN_MATCHED, floor: int | None = None, wanted: float = 0.0) -> np.ndarray:
    """Which words of the item (as numbers) are matched in passages of the document.

    Smith-Waterman, best passage first; the words of a passage are then taken out on both
    sides, and the search goes on until no passage scores the floor.  Only passages that match
    the least number of words count.  The search ends as well when too few words are left for a
    passage, or for the wanted number in all.  Words of the item below 0 are left out, and so are those
    of the document below -2, which end a passage.
    """
    floor = MATCH * least if floor is None else floor
    taken = np.zeros(len(item), bool)
    item, doc = item.copy(), doc.copy()
    ends = np.nonzero(doc < -2)[0]
    apart = 2 * MATCH * len(item)
    costs = np.full(len(doc) + 1, -GAP, np.int32)
    costs[ends + 1] = apart
    costs[0] = 0
    steps = np.cumsum(costs, dtype=np.int32)
    h = np.zeros((len(item) + 1, len(doc) + 1), np.int32)
    while True:
        open_words = item[item >= 0]
        left = int(np.isin(open_words, doc).sum())
        if left < least or left + taken.sum() < wanted:
            break
        for i in range(len(item)):
            row = h[i + 1]
            row[:] = 0
            if item[i] < 0:
                continue
            step = np.where(doc == item[i], MATCH, MISMATCH)
            step[ends] = -apart
            np.maximum(row[1:], h[i, :-1] + step, out=row[1:])
            np.maximum(row, h[i] + GAP, out=row)
            row += steps
            np.maximum.accumulate(row, out=row)
            row -= steps
        i, j = np.unravel_index(int(h.argmax()), h.shape)
        if h[i, j] < floor:
            break
        end, matched = j, []
        while h[i, j] > 0:
            here = h[i, j]
            if i and j and here - h[i - 1, j - 1] == (MATCH if item[i - 1] == doc[j - 1] else MISMATCH):
                if item[i - 1] == doc[j - 1]:
                    matched.append(i - 1)
                i, j = i - 1, j - 1
            elif i and here - h[i - 1, j] == GAP:
                i -= 1
            elif j:
                j -= 1
            else:
                break
        doc[j:end] = -2
        if len(matched) >= least:
            taken[matched] = True
            item[matched] = -1
    return taken


class _Block:
    """A block of items in the form that tasks use: word numbers, and n-grams as sorted codes."""

    def __init__(self, rows: list[tuple[int, list[str]]]):
        self.numbers: dict[str, int] = {}
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.items = [np.array([self.numbers.setdefault(w, len(self.numbers)) for w in r[1]], np.int64) for r in rows]
        base = len(self.numbers) + 1
        if base**N >= 2**62:
            raise ValueError("too many different words in a block of items")
        self.base = base
        codes, owners, times = [], [], []
        for k, item in enumerate(self.items):
            c, n = np.unique(self.grams(item), return_counts=True)
            codes.append(c)
            owners.append(np.full(len(c), k))
            times.append(n)
        codes, owners, times = (np.concatenate(x or [np.empty(0, np.int64)]) for x in (codes, owners, times))
        order = np.lexsort((owners, codes))
        self.pair_codes, self.pair_owners, self.pair_times = codes[order], owners[order].astype(np.int32), times[order].astype(np.int32)
        self.codes, self.starts = np.unique(self.pair_codes, return_index=True)
        self.shared = np.diff(np.append(self.starts, len(self.pair_codes)))
        self.lengths = np.array([len(x) for x in self.items], np.int64)
        # all items one after the other, with room between them that holds nothing
        room = N + SEEDED_REACH
        self.mark = np.zeros(len(self.codes) + 1, bool)
        self.first = room + np.cumsum(self.lengths + room) - self.lengths - room
        total = int(self.lengths.sum()) + room * (len(self.items) + 1)
        self.words, self.places = np.full(total, len(self.numbers), np.int32), np.full(total, len(self.codes), np.int32)
        for at, item in zip(self.first, self.items):
            self.words[at : at + len(item)] = item
            self.places[at : at + max(0, len(item) - N + 1)] = np.searchsorted(self.codes, self.grams(item))

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """Codes of the n-grams; those with a word that no item has are negative."""
        n = len(ids) - N + 1
        if n <= 0:
            return np.empty(0, np.int64)
        code, known = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(N):
            part = ids[i : i + n]
            code = code * self.base + part
            known &= part >= 0
        return np.where(known, code, -1)

    def encode(self, text: str) -> np.ndarray:
        get = self.numbers.get
        found = words(text)
        return np.fromiter(map(get, found, repeat(-1)), np.int64, len(found))

    def look_up(self, ids: np.ndarray) -> np.ndarray:
        """Index into codes of the n-gram that begins at each place of a text; their number where no item has it."""
        c = self.grams(ids)
        if not len(self.codes):
            return np.zeros(len(c), np.int64)
        at = np.searchsorted(self.codes, c)
        at[at == len(self.codes)] = 0
        return np.where(self.codes[at] == c, at, len(self.codes))

    def find(self, ids: np.ndarray) -> np.ndarray:
        """Indexes into codes of the different n-grams of a text."""
        at = self.look_up(ids)
        return np.unique(at[at < len(self.codes)])

    def pairs(self, found: np.ndarray) -> np.ndarray:
        """Indexes of the (gram, item) pairs of the grams at those indexes into codes."""
        n = self.shared[found]
        return np.repeat(self.starts[found] - np.cumsum(n) + n, n) + np.arange(n.sum())

    def near(self, items: np.ndarray, reach: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places in words of those items, one after the other; whether a gram that was found is
        within an item's reach of each; where each item begins in them)."""
        n = self.lengths[items]
        begin = np.cumsum(n) - n
        at = np.repeat(self.first[items] - begin, n) + np.arange(n.sum())
        reach = np.repeat(reach, n)
        hits = np.repeat(np.cumsum(n + N + SEEDED_REACH) - n, n) + np.arange(n.sum()) - np.repeat(begin, n)
        known = np.zeros(int(n.sum()) + (N + SEEDED_REACH) * (len(items) + 1), np.int32)
        known[hits] = found[self.places[at]]
        before = np.concatenate([[0], np.cumsum(known)])
        return at, before[hits + reach + 1] - before[hits - reach - N + 1] > 0, begin


def _count(block):
    def run(batches):
        b = block.value
        total = np.zeros(len(b.codes), np.int64)
        n = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total[b.find(b.encode(text))] += 1
                n += 1
        hit = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1), pa.int64()), pa.array(np.append(total[hit], n), pa.int64())], ["gram", "docs"])

    return run


def held_share(b: "_Block", k: int, item: np.ndarray, ids: np.ndarray, places: np.ndarray, share: float) -> float:
    """The share of an item's words that passages of a document hold; item has -1 at words that are not to be aligned."""
    own, length, reach = b.places[b.first[k] : b.first[k] + b.lengths[k]], int(b.lengths[k]), 2 * SEEDED_REACH
    b.mark[own] = True
    b.mark[-1] = False
    at = np.nonzero(b.mark[places])[0]
    b.mark[own] = False
    hits, where = np.nonzero(places[at][:, None] == own[None, :]) if len(at) * length < 100_000 else ((), ())
    if 0 < len(hits) <= 100:
        # words that can be matched at all: in the document, too, near an n-gram that both have
        can = np.zeros(length, bool)
        for p, q in zip(at[hits].tolist(), where.tolist()):
            x, y = max(0, q - SEEDED_REACH), q + N + SEEDED_REACH
            can[x:y] |= (item[x:y, None] == ids[None, max(0, p - reach) : p + N + reach]).any(1)
        if (can & (item >= 0)).sum() < share * length:
            return 0.0
    # the parts of the document near the n-grams that both have, cut where nothing is near
    cuts = np.nonzero(np.diff(at) > 2 * reach + N)[0]
    begins, ends = np.maximum(at[np.append(0, cuts + 1)] - reach, 0), np.minimum(at[np.append(cuts, len(at) - 1)] + N + reach, len(ids))
    least = least_passage(length, share)
    taken, item, part, size = np.zeros(length, bool), item.copy(), [], 0
    bounds = [(x, min(x + PIECE, y)) for s, y in zip(begins.tolist(), ends.tolist()) for x in range(s, y, PIECE - 4 * length if PIECE > 8 * length else PIECE) if x == s or x + 4 * length < y]
    for n, (x, y) in enumerate(bounds):
        part += [ids[x:y], np.array([-3])]
        size += y - x
        if size >= PIECE or n == len(bounds) - 1:
            last = n == len(bounds) - 1
            got = align(item, np.concatenate(part), least, min(FLOOR, MATCH * least), share * length - taken.sum() if last else 0.0)
            taken |= got
            item[got] = -1
            part, size = [], 0
    n = int(taken.sum())
    return n / length if n > FEW or n == length else 0.0


def _join(block, seeds, share: float):
    def run(batches):
        b, seed = block.value, seeds.value
        least = np.minimum(MIN_SEEDS, b.lengths - N + 1)
        found, known = np.zeros(len(b.codes) + 1, bool), np.zeros(len(b.numbers) + 1, bool)
        for batch in batches:
            docs, items, shares = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = b.encode(text)
                places = b.look_up(ids)
                grams = np.unique(places[places < len(b.codes)])
                if not len(grams):
                    continue
                pairs = b.pairs(grams)
                some, owners = np.unique(b.pair_owners[pairs], return_inverse=True)
                seeded = np.bincount(owners, seed[pairs], len(some)) >= least[some]
                wide = np.bincount(owners, b.pair_times[pairs], len(some)) * (N + 2 * REACH) >= share * b.lengths[some]
                some, seeded = some[seeded | wide], seeded[seeded | wide]
                if not len(some):
                    continue
                has = ids[ids >= 0]
                found[grams] = known[has] = True
                at, near, begin = b.near(some, np.where(seeded, SEEDED_REACH, REACH), found)
                near_words = b.words[at]
                # a pair can only reach the share if the document has so many of the item's words near what both have
                enough = np.add.reduceat(near & known[near_words], begin) >= share * b.lengths[some]
                for n in np.nonzero(enough)[0]:
                    k, cut = some[n], slice(begin[n], begin[n] + b.lengths[some[n]])
                    got = held_share(b, k, np.where(near[cut], near_words[cut], -1), ids, places, share)
                    if got >= share:
                        docs.append(doc_id)
                        items.append(int(b.ids[k]))
                        shares.append(got)
                found[grams] = known[has] = False
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int32()), pa.array(shares, pa.float64())], ["doc_id", "item_id", "share"])

    return run


def leaks(documents: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, share): the documents that hold at least that share of an item's own words."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and trim(text) <> ''")
    own = own_words(items.select(F.col("item_id").cast("int").alias("item_id"), "text"))
    size = own.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0)).alias("w")).first()
    blocks = max(1, -(-size["w"] // BLOCK_WORDS))
    out = []
    for k in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id").collect()
        made = _Block([(r["item_id"], w) for r in rows if len(w := words(r["text"])) >= N])
        block = spark.sparkContext.broadcast(made)
        counts = docs.select("text").mapInArrow(_count(block), "gram bigint, docs bigint").groupBy("gram").agg(F.sum("docs").alias("docs")).collect()
        df, total = np.zeros(len(made.codes), np.int64), 0
        for r in counts:
            if r["gram"] < 0:
                total = r["docs"]
            else:
                df[r["gram"]] = r["docs"]
        seeds = spark.sparkContext.broadcast(_seeds(made, df, total))
        out.append(docs.mapInArrow(_join(block, seeds, share), "doc_id bigint, item_id int, share double"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.dropDuplicates(["doc_id", "item_id"])


def _seeds(b: _Block, df: np.ndarray, total: int) -> np.ndarray:
    """Of each (gram, item) pair whether it is a seed: the gram is rare, or among the rarer half
    of the item's grams, or of those that occur at all (so that an item that leaked into very
    many documents keeps its seeds)."""
    per_pair = np.repeat(df, b.shared)
    items = np.repeat(b.shared, b.shared)
    seed = (per_pair <= max(5.0, RARE_SHARE * total)) & (items <= RARE_ITEMS)
    order = np.lexsort((per_pair, items, b.pair_owners))
    for ranked in (order, order[per_pair[order] > 0]):
        owners = b.pair_owners[ranked]
        begin = np.searchsorted(owners, owners)
        size = np.bincount(owners, minlength=len(b.items))[owners]
        seed[ranked] |= (np.arange(len(ranked)) - begin) * 2 < size
    return seed


def leaked_items(found: DataFrame, items: DataFrame) -> DataFrame:
    """Per leaked item: suite, kind, documents that hold it, and the largest share held."""
    by = found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("share").alias("largest_share"))
    return items.select("item_id", "suite", "kind").dropDuplicates(["item_id"]).join(by, "item_id")
