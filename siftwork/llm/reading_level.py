"""Problem 8: the reading level of each document with English prose.

Prose is what is left without code, tables, headings, logs and links; its language is told
by function words.  Syntax and vocabulary features of the labelled documents (a bounded,
documented sample) train a linear pairwise ranker, whose scores isotonic regression turns
into levels.  The fitted model is a few numbers, and scoring is a map over all documents.

Defined results: null and blank texts and texts without (English) prose get no row; a
document delivered more than once gets one row; null bands do not count and repeated
labels count once; without any usable label there is nothing to learn from and no row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents and pairs of them that the ranker learns from at most.
MAX_LABELLED, MAX_PAIRS = 20_000, 200_000
MIN_WORDS = 8
LANGUAGE_SHARE = 0.08

# Function words, by language and by role.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for with as be this not you by or are if before so then on when each can has have at from an which will your was were their its these but do we they".split(),
    "de": "der die das und ist nicht ein eine den dem des mit für auf sich wird werden zu von im auch wenn oder als bei nach wie aus noch weil einen einer sind".split(),
    "es": "el la los las de y que en un una es no se por con para del al como más pero su si cuando o está lo cada sin son".split(),
    "fr": "le la les de et que en un une est pas ne se par avec pour du au des dans plus ce qui sur ou si il chaque quand sont son".split(),
}
_ROLES = {
    "subordinate": "which that whereas although because unless while whenever if until since inasmuch though whether whose whom wherein whereby once provided lest",
    "address": "you your yours please let we us our",
    "preposition": "of in by with from into upon through between among under over without within across against during toward towards regarding concerning throughout notwithstanding",
    "linking": "however moreover furthermore therefore consequently nevertheless accordingly hence thus notwithstanding correspondingly conversely theoretically essentially",
    "auxiliary": "would could might ought should must may shall been being having",
    "plain": "so then now first next too and but it is a the do go look see use run find make type pick new old good small big red full last",
}
_NOMINAL = ("tion", "sion", "ment", "ness", "ity", "ance", "ence", "ism", "ship", "tions", "sions", "ments", "ities", "ances", "ences")
_LATINATE = ("al", "ive", "ous", "ic", "ible", "able", "ary", "ate", "ize", "ify")
_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*\r?$|\Z)", re.M | re.S)
_DROP = re.compile(r"^\s*(?:\||#{1,6}\s|\d{1,4}[-:/]\d{2}\b|\[?\d{4}-\d\d|(?:https?|ftp)://\S+\s*$|[-=*_]{3,}\s*$|(?:INFO|WARN|ERROR|DEBUG|TRACE)\b|\$ |> ?$|at [\w.$]+\()")
_LINK = re.compile(r"!?\[([^\]]*)\]\([^)]*\)|https?://\S+|`[^`]*`")
_MARK = re.compile(r"^\s*(?:[-*+>]|\d+[.)])\s+")
_TOKEN = re.compile(r"[^\W\d_][\w'’]*|[.!?]+(?=\s|$)|[,;:()—]|\n")
_VOWELS = re.compile(r"[aeiouy]+")

_WORD_FEATURES = ("letters", "seven", "ten", "thirteen", "syllables", "nominal", "latinate", "adverb", *_ROLES)
FEATURES = (*(f"{x}_by_word" for x in _WORD_FEATURES), *(f"{x}_by_sentence" for x in _WORD_FEATURES), "sentence", "log_sentence", "short", "middle", "long", "longest", "commas", "commas_by_word")


def prose(text: str) -> str:
    """The running text of a document; a line that goes on in lower case is joined to the one before."""
    out, blank = [], True
    for line in _FENCE.sub("\n\n", text.replace("\r\n", "\n")).split("\n"):
        s = line.strip()
        if not s or _DROP.match(line) or line.startswith(("    ", "\t")) and blank:
            blank = blank or not s
            if not s and out and out[-1] != "":
                out.append("")
            continue
        blank = False
        out.append(_MARK.sub("\n", _LINK.sub(r"\1", line)) if _MARK.match(line) else _LINK.sub(r"\1", s))
    return re.sub(r"\n(?=[a-zäöüßéèàñ])", " ", "\n".join(out))


_LANGUAGES = tuple(FUNCTION_WORDS)


class _Words(dict):
    """Token to row of a table: its features, then a mark for each language it is a function word of.

    Sentence ends, commas, and names and identifiers have the rows END, COMMA and NAME.
    """

    END, COMMA, NAME = 0, 1, 2
    WIDTH = len(_WORD_FEATURES) + len(_LANGUAGES)

    def __init__(self):
        super().__init__()
        self.role = {w: i for i, ws in enumerate(_ROLES.values()) for w in ws.split()}
        self.language = [frozenset(v) for v in FUNCTION_WORDS.values()]
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.table, self.used = np.zeros((4096, self.WIDTH)), 3

    def __missing__(self, token: str) -> int:
        c = token[0]
        if c in ".!?\n":
            k = self.END
        elif c in ",;:()—":
            k = self.COMMA
        elif not token.islower() and not (c.isupper() and (len(token) == 1 or token[1:].islower())) or any(x.isdigit() or x == "_" for x in token):
            k = self.NAME
        else:
            w, k = token.lower(), self.used
            n = len(w)
            if k == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            row = self.table[k]
            row[:5] = n, n >= 7, n >= 10, n >= 13, max(1, len(_VOWELS.findall(w)))
            row[5] = n > 6 and w.endswith(_NOMINAL)
            row[6] = n > 5 and w.endswith(_LATINATE)
            row[7] = n > 4 and w.endswith("ly")
            if w in self.role:
                row[8 + self.role[w]] = 1
            row[len(_WORD_FEATURES) :] = [w in words for words in self.language]
            self.used += 1
        self[token] = k
        return k


_words = _Words()


def features(text: str | None) -> np.ndarray | None:
    """The features of a text with English prose, else None."""
    tokens = _TOKEN.findall(prose(text)) if text else []
    if len(_words) > 100_000:
        _words.reset()
    ids = np.array([_words[t] for t in tokens], np.intp)
    rows = _words.table[ids]
    words = np.count_nonzero(ids >= _Words.NAME)
    if words < MIN_WORDS:
        return None
    known = rows[:, len(_WORD_FEATURES) :].sum(0)
    if _LANGUAGES[int(known.argmax())] != "en" or known.max() < LANGUAGE_SHARE * words:
        return None
    # a capital inside a sentence begins a name, which says nothing about the language used
    name = np.array([t[0].isupper() for t in tokens]) & np.concatenate([[False], ids[:-1] != _Words.END])
    word = (ids > _Words.NAME) & ~name
    counted = word | name | (ids == _Words.NAME)
    first = np.concatenate([[0], np.nonzero(ids[:-1] == _Words.END)[0] + 1])
    length, plain, commas = (np.add.reduceat(x.astype(float), first) for x in (counted, word, ids == _Words.COMMA))
    real = (length >= 3) & (plain >= 2)
    if not real.any():
        return None
    sums = np.add.reduceat(rows[:, : len(_WORD_FEATURES)] * word[:, None], first)[real]
    length, plain, commas = length[real], plain[real], commas[real]
    by_word = sums.sum(0) / plain.sum()
    by_sentence = (sums / plain[:, None]).mean(0)
    shape = [length.mean(), np.log(length).mean(), (length < 9).mean(), ((length >= 9) & (length < 24)).mean(), (length >= 24).mean(), (length >= 38).mean(), commas.mean(), commas.sum() / length.sum()]
    return np.concatenate([by_word, by_sentence, shape])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    scores: np.ndarray  # knots of the isotonic step from score to level
    levels: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def level(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.score(x), self.scores, self.levels)

    def band(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(self.level(x) + 0.5), 1, 4).astype(int)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, fitted y) of the weighted least-squares rising step function (pooled neighbours)."""
    order = np.argsort(x, kind="stable")
    pools: list[list] = []
    for i in order:
        pools.append([y[i] * w[i], w[i], x[i], x[i]])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a = pools.pop()
            pools[-1] = [pools[-1][0] + a[0], pools[-1][1] + a[1], pools[-1][2], a[3]]
    xs = np.array([v for p in pools for v in ((p[2],) if p[2] == p[3] else (p[2], p[3]))])
    ys = np.array([p[0] / p[1] for p in pools for _ in range(1 if p[2] == p[3] else 2)])
    return xs, ys


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 3.0, steps: int = 25, seed: int = 7) -> Model:
    """The ranker: logistic regression on differences of pairs with unequal levels, by Newton steps."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    i, j = np.triu_indices(len(y), 1) if len(y) * (len(y) - 1) // 2 <= MAX_PAIRS else rng.integers(0, len(y), (2, MAX_PAIRS))
    keep = np.abs(y[i] - y[j]) > 0.25
    i, j = i[keep], j[keep]
    sign = np.sign(y[i] - y[j])
    d = (z[i] - z[j]) * sign[:, None]
    weight = np.abs(y[i] - y[j]) * np.sqrt(w[i] * w[j]) / max(1, len(sign)) * len(y)
    beta = np.zeros(x.shape[1])
    for _ in range(steps if len(sign) else 0):
        p = 1 / (1 + np.exp(np.clip(d @ beta, -30, 30)))
        grad = d.T @ (weight * p) - ridge * beta
        hess = (d * (weight * p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean, scale, beta, *isotonic(z @ beta, y, w))


def _featurise(batches):
    for b in batches:
        out: list[list] = [[], []]
        for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            f = features(t)
            if f is not None:
                out[0].append(d)
                out[1].append(f.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.float64()))], ["doc_id", "x"])


def train(documents: DataFrame, labels: DataFrame) -> Model | None:
    """Fits the model on at most MAX_LABELLED labelled documents, taken by the hash of their id."""
    rated = labels.where("band between 1 and 4 and doc_id is not null").select("label_id", "doc_id", "rater_id", "band").distinct()
    by = rated.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("band").alias("level"), F.count("*").cast("double").alias("votes"))
    sample = by.orderBy(F.xxhash64("doc_id")).limit(MAX_LABELLED)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("trim(text) <> ''").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")  # MAX_LABELLED ids at most
    rows = texts.mapInArrow(_featurise, "doc_id bigint, x array<double>").dropDuplicates(["doc_id"]).join(sample, "doc_id").orderBy("doc_id").collect()
    if not rows:
        return None
    return fit(np.array([r["x"] for r in rows]), np.array([r["level"] for r in rows]), np.array([r["votes"] for r in rows]))


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, band, level): a row for each document with English prose."""
    spark = documents.sparkSession
    schema = "doc_id bigint, band int, level double"
    model = train(documents, labels)
    if model is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)

    def score(batches):
        m = shared.value
        for b in _featurise(batches):
            x = np.array(b.column("x").to_pylist()).reshape(len(b), len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(m.band(x), pa.int32()), pa.array(m.level(x))], ["doc_id", "band", "level"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and trim(text) <> ''").mapInArrow(score, schema).dropDuplicates(["doc_id"])


def profile(documents: DataFrame, levels: DataFrame) -> DataFrame:
    """Per source (trimmed, lower case; null stays null): documents in each band, and their mean level."""
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.trim("source")).alias("source")).dropDuplicates(["doc_id"])
    counts = [F.count_if(F.col("band") == b).alias(f"band_{b}") for b in (1, 2, 3, 4)]
    return levels.join(source, "doc_id").groupBy("source").agg(F.count("*").alias("documents"), *counts, F.avg("level").alias("mean_level"))
