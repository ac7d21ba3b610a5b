"""Problems 6, 7 and 8: leaks, mixtures, reading levels."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwork.llm import contamination as C
from siftwork.llm import mixing as M
from siftwork.llm import reading_level as R

DOCS = "doc_id long, text string, lang string, source string, item_id int, share double, band int, tokens int"
ITEMS = "item_id int, suite string, kind string, text string, doc_id long"


def documents(spark, *rows):
    return spark.createDataFrame([(i, t, "xx", s, 0, 0.0, 9, 0) for i, t, s in rows], DOCS)


def items(spark, *rows):
    return spark.createDataFrame([(i, "a", "qa", t, 0) for i, t in rows], ITEMS)


WORDS = [a + b for a in "alpha beta gamma delta omega sigma kappa theta lambda zeta".split() for b in "one two three four five six".split()]


def text(seed, n=40):
    return " ".join(random.Random(seed).sample(WORDS, n))


# -- 6 --------------------------------------------------------------------------------


def best_local(a, b):
    """Plain Smith-Waterman score."""
    h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1][j + 1] = max(0, h[i][j] + (C.MATCH if a[i] == b[j] else C.MISMATCH), h[i][j + 1] + C.GAP, h[i + 1][j] + C.GAP)
    return max(map(max, h))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=8, max_size=24), st.lists(st.integers(0, 6), min_size=8, max_size=40))
def test_alignment_finds_the_best_passage(a, b):
    taken = C.align(np.array(a), np.array(b))
    if best_local(a, b) < C.MATCH * C.MIN_MATCHED:
        assert not taken.any()
    elif taken.any():
        assert taken.sum() >= C.MIN_MATCHED
    assert C.align(np.array(a), np.array(a)).sum() >= (len(a) if len(set(a)) == len(a) else 0)


def test_leaks(spark):
    stock = "Answer the question using only the passage that follows. "
    own = {i: text(i) for i in range(1, 6)}
    its = items(spark, *((i, stock + t) for i, t in own.items()), (6, None), (7, ""), (8, stock), (1, stock + own[1]))
    w1, w2 = own[1].split(), own[2].split()
    edited = " ".join("changed" if k % 9 == 4 else w.upper() + "," for k, w in enumerate(w2))
    docs = documents(
        spark,
        (1, "Before. " + own[1] + " After.", "s"), (2, "* " + "\n* ".join(own[1].split()), "s"), (3, edited, "s"), (4, " ".join(w1[:10]), "s"), (5, stock + " and nothing more of it", "s"),
        (6, " ".join(w1[:12]) + " filler" * 30 + " " + " ".join(w1[20:32]), "s"), (7, None, None), (8, "", "s"), (9, own[3] + "\n\n" + own[4], "s"), (1, "Before. " + own[1] + " After.", "s"), (10, "unrelated " * 5000, "s"),
    )
    got = sorted((r["doc_id"], r["item_id"]) for r in C.leaks(docs, its).collect())
    assert got == [(1, 1), (2, 1), (3, 2), (6, 1), (9, 3), (9, 4)]
    report = {r["item_id"]: r["documents"] for r in C.leaked_items(C.leaks(docs, its), its).collect()}
    assert report == {1: 3, 2: 1, 3: 1, 4: 1}


def test_an_item_in_every_document_keeps_its_seeds(spark):
    own = text(3)
    docs = documents(spark, *((i, f"doc {i} " + own, "s") for i in range(60)))
    assert C.leaks(docs, items(spark, (1, own), (2, text(9)))).count() == 60


def test_a_passage_of_two_fifths_in_many_documents_is_found(spark):
    own = {i: [f"w{i}x{k}" for k in range(100)] for i in (1, 2)}
    rows = [(100 * i + n, f"doc {n} " + " ".join(w[:45]), "s") for i, w in own.items() for n in range(20)]
    rows += [(1000, " ".join(own[2][43:]), "s")]  # the other grams of item 2 occur as well, and more rarely
    got = {(r["doc_id"], r["item_id"]) for r in C.leaks(documents(spark, *rows), items(spark, *((i, " ".join(w)) for i, w in own.items()))).collect()}
    assert got == {(100 * i + n, i) for i in own for n in range(20)} | {(1000, 2)}


def test_edited_sentences_far_apart_count_by_their_words(spark):
    own = [f"w{k}" for k in range(60)]
    edited = [[f"new{a}x{k}" if k in (3, 7, 11) else w for k, w in enumerate(own[a : a + 15])] for a in (5, 40)]
    text = " ".join([*edited[0], *["filler"] * 30, *edited[1]])
    few = " ".join([*own[:7], *["filler"] * 30, *own[10:17], *["filler"] * 30, *own[20:27], *["filler"] * 30, *own[30:37]])
    got = C.leaks(documents(spark, (1, text, "s"), (2, few, "s")), items(spark, (1, " ".join(own)))).collect()
    assert [(r["doc_id"], r["item_id"], r["share"]) for r in got] == [(1, 1, 0.4)]


def test_short_items_count_by_their_share(spark):
    seven, eighteen = [f"s{k}" for k in range(7)], [f"e{k}" for k in range(18)]
    docs = documents(
        spark, (1, "so: " + " ".join(seven) + ".", "s"), (2, " ".join(["x", *eighteen[2:6], *["filler"] * 40, *eighteen[9:13], "y"]), "s"), (3, " ".join(seven[:4]) + " and more", "s"), (4, "a " + " ".join(["t0", "t1", "t2"]), "s"), (5, " ".join(eighteen[:5]), "s"),
    )
    its = items(spark, (1, " ".join(seven)), (2, " ".join(eighteen)), (3, "t0 t1 t2"), (4, "one two"))
    assert sorted((r["doc_id"], r["item_id"]) for r in C.leaks(docs, its).collect()) == [(1, 1), (2, 2), (4, 3)]


def test_a_long_document_is_aligned_near_its_hits_only():
    import tracemalloc

    item = [f"w{k}" for k in range(100)]
    b = C._Block([(1, item)])
    filler = ["w3 w4 other"] * 1000 + ["other words"] * 498_000
    text = " ".join([*filler, " ".join(item[:60]), *filler[::-1]])
    ids = b.encode(text)
    places = b.look_up(ids)
    tracemalloc.start()
    share = C.held_share(b, 0, b.items[0], ids, places, 0.4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ids) > 1_000_000 and share == 0.6 and peak < 200 * 2**20
    many = b.encode(" ".join([*item] * 10_000))
    assert len(many) == 1_000_000 and C.held_share(b, 0, b.items[0], many[:200_000], b.look_up(many[:200_000]), 0.4) == 1.0


def test_seeds_lose_nothing_that_full_alignment_finds():
    """Every document against every item without seeds or windows, on texts with shared phrases and edits."""
    r = random.Random(5)
    phrases = [[f"p{k}x{j}" for j in range(6)] for k in range(12)]
    own = {i: [w for _ in range(12) for w in (r.choice(phrases) if r.random() < 0.4 else [f"i{i}x{r.randrange(400)}" for _ in range(5)])] for i in range(10)}
    docs = []
    for n in range(60):
        i, share = r.randrange(10), r.choice([0.2, 0.45, 0.6, 1.0])
        part = own[i][: int(share * len(own[i]))]
        part = [w if r.random() > 0.08 else f"new{n}" for w in part]
        docs.append((n, [*r.choice(phrases), *["filler"] * 20, *part, *r.choice(phrases)]))
    b = C._Block(list(own.items()))
    df = np.zeros(len(b.codes), np.int64)
    for _, w in docs:
        df[b.find(b.encode(" ".join(w)))] += 1
    batch = __import__("pyarrow").RecordBatch.from_pylist([{"doc_id": n, "text": " ".join(w)} for n, w in docs])
    held = lambda x: type("V", (), {"value": x})()
    found = next(C._join(held(b), held(C._seeds(b, df, len(docs))), 0.4)([batch]))
    got = set(zip(found["doc_id"].to_pylist(), found["item_id"].to_pylist()))
    full = {(n, i) for n, w in docs for k, i in enumerate(b.ids) if C.align(b.items[k], b.encode(" ".join(w)), C.least_passage(len(b.items[k])), C.FLOOR).sum() >= 0.4 * len(b.items[k])}
    assert got <= full and len(full) > 20 and len(got) >= 0.9 * len(full)


def test_blocks_give_the_same(spark, monkeypatch):
    its = items(spark, *((i, text(i)) for i in range(12)))
    docs = documents(spark, *((i, text(i) + " end", "s") for i in range(0, 12, 2)))
    one = sorted(C.leaks(docs, its).collect())
    monkeypatch.setattr(C, "BLOCK_WORDS", 150)
    assert sorted(C.leaks(docs, its).collect()) == one and len(one) == 6


def test_empty_tables_of_items_and_documents(spark):
    assert C.leaks(documents(spark), items(spark, (1, text(1)))).count() == 0
    assert C.leaks(documents(spark, (1, text(1), "s")), items(spark)).count() == 0


# -- 7 --------------------------------------------------------------------------------

WEIGHTS = "source string, target_share double, max_repeats int, doc_id long, shard int"


def weights(spark, *rows):
    return spark.createDataFrame([(s, w, m, 0, 0) for s, w, m in rows], WEIGHTS)


def sainte_lague(shares, seats):
    """Brute force by the highest quotients."""
    quotients = sorted(((-w / (2 * k + 1), -w, s) for s, w in shares.items() for k in range(seats)))[:seats]
    return {s: sum(q[2] == s for q in quotients) for s in shares}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.floats(0.01, 1), min_size=1), st.integers(1, 60))
def test_apportionment_against_brute_force(shares, seats):
    plan = M.apportion(dict.fromkeys(shares, 10**9), shares, dict.fromkeys(shares, 1), float(seats), seats, 4)
    assert plan.quotas == sainte_lague(shares, seats)
    per_shard = [sum(a[2] == k for a in plan.awards) for k in range(4)]
    assert sum(per_shard) == seats and max(per_shard) - min(per_shard) <= 1


def test_caps_pass_blocks_on():
    plan = M.apportion({"a": 10, "b": 1000}, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 1}, 100.0, 100, 1)
    assert plan.quotas == {"a": 20, "b": 80}
    exact = M.apportion({"a": 10, "b": 1000}, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 1}, "strict", 100, 1)
    assert exact.quotas == {"a": 50, "b": 50} and exact.block * 100 == pytest.approx(40)
    assert M.apportion({}, {"a": 1.0}, {"a": 1}).awards == []


def test_a_small_source_does_not_set_the_size():
    sizes, shares, once = {"tiny": 10, "b": 5000, "c": 9000}, {"tiny": 0.1, "b": 0.4, "c": 0.5}, {"tiny": 1, "b": 1, "c": 1}
    plan = M.apportion(sizes, shares, once, None, 1000, 1)
    assert plan.total == 12500 and plan.quotas == {"tiny": 1, "b": 400, "c": 500} and plan.wanted == {"tiny": 10, "b": 5000, "c": 6250}
    assert M.apportion(sizes, shares, once, None, 1000, 1, least=100).block >= 100


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_shares_of_the_tables_are_reached(spark, data, scale):
    folder = data.replace("sf0.001", scale)
    mix = M.mix(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/source_weights.parquet"))
    rows = [r for r in mix.report.collect() if r["records"]]
    record = mix.records.agg({"tokens": "max"}).first()[0]
    total = sum(r["target_tokens"] for r in rows)
    able = [r for r in rows if r["available_tokens"] * r["max_repeats"] >= r["target_tokens"]]
    assert sum(r["target_tokens"] for r in able) >= 0.8 * total and sum(r["tokens"] for r in rows) >= 0.8 * total and len(rows) > 20
    for r in able:
        assert abs(r["tokens"] - r["target_tokens"]) <= max(0.01 * r["target_tokens"], record), r
        assert r["most_copies"] <= r["max_repeats"]
    for r in rows:
        if r not in able:
            assert r["tokens"] == r["available_tokens"] * r["max_repeats"] and r["shortfall_tokens"] > 0


def test_mixture(spark):
    rows = [(i, f"words number {i} " * 5, " Big\t" if i % 2 else "big") for i in range(300)]
    rows += [(1000 + i, f"few {i} " * 15, "small") for i in range(10)] + [(5000, "alone", None), (5001, "unlisted", "other"), (5002, "", "big"), (5003, None, "big"), (0, "words number 0 " * 5, "big")]
    w = weights(spark, ("BIG ", 0.7, 1), ("big", 0.6, 1), ("small", 0.3, 3), ("gone", 0.2, 1), (None, 0.5, 1), ("bad", None, 1), ("none", 0.1, 0))
    mix = M.mix(documents(spark, *rows), w, seats=1000, shards=4)
    got = mix.records.collect()
    sizes = {r["doc_id"]: r["tokens"] for r in got}
    assert all(r["source"] in ("big", "small") and 0 <= r["shard"] < 4 and 1 <= r["copy"] <= 3 for r in got)
    assert len({(r["doc_id"], r["copy"]) for r in got}) == len(got)
    total = sum(r["tokens"] for r in got)
    share = sum(r["tokens"] for r in got if r["source"] == "small") / total
    assert share == pytest.approx(0.3, abs=0.02) and sizes
    report = {r["source"]: r for r in mix.report.collect()}
    assert report["small"]["actual_share"] == pytest.approx(share) and report["gone"]["tokens"] == 0 and report["big"]["records"] == 300
    assert sorted(got) == sorted(M.mix(documents(spark, *rows[::-1]).repartition(3), w, seats=1000, shards=4).records.collect())
    full = {r["source"]: r for r in M.mix(documents(spark, *rows), w, "all", 1000).report.collect()}
    assert full["small"]["most_copies"] == 3 and full["big"]["most_copies"] == 1


def test_mixture_of_nothing(spark):
    assert M.mix(documents(spark), weights(spark, ("a", 1.0, 1))).records.count() == 0
    mix = M.mix(documents(spark, (1, "x", "a")), weights(spark))
    assert mix.records.count() == 0 and mix.report.count() == 0


# -- 8 --------------------------------------------------------------------------------

EASY = ["Go to the page. Then look for the red one. Is it big? Close it now.", "You can find it. So run it now. The map is new too. Ask me to fix it."]
HARD = ["Notwithstanding the architectural implications of generalization, practitioners contemplating the reconciliation of heterogeneous representations ought to acknowledge that the responsibilities traditionally associated with parameterization are redistributed among participants whose understanding of normalization remains necessarily incomplete."]


def prose(level, seed):
    r = random.Random(seed)
    return " ".join(r.choice(HARD if r.random() * 3 < level - 1 else EASY) for _ in range(9))


def labels(spark, *rows):
    return spark.createDataFrame([(n, d, 1, b, None) for n, (d, b) in enumerate(rows)], "label_id long, doc_id long, rater_id int, band int, text string")


def test_levels_follow_the_labels(spark):
    docs = [(i, prose(1 + 3 * (i % 2), i), "s") for i in range(40)] + [(100, None, "s"), (101, " ", "s"), (102, "```\nx = 1\n```", "s"), (103, "Wenn die Datei fehlt, liest das Werkzeug die Liste und meldet einen Fehler. Das ist nicht gut für die Liste.", "s"), (104, "10:01 INFO a b\n10:02 INFO the of and\n" * 9, None), (105, "| the | of |\n" * 20, "s"), (0, prose(1, 0), "s")]
    known = [(i, 1 + 3 * (i % 2)) for i in range(30)] + [(3, None), (999, 2)]
    got = {r["doc_id"]: r["band"] for r in R.reading_levels(documents(spark, *docs), labels(spark, *known)).collect()}
    assert got == {i: 1 + 3 * (i % 2) for i in range(40)}
    profile = R.profile(documents(spark, *docs), R.reading_levels(documents(spark, *docs), labels(spark, *known))).collect()
    assert [(r["source"], r["documents"], r["band_1"], r["band_4"]) for r in profile] == [("s", 40, 20, 20)]


def test_nothing_to_learn_from(spark):
    docs = documents(spark, (1, prose(1, 1), "s"))
    assert R.reading_levels(docs, labels(spark)).count() == 0
    assert R.reading_levels(documents(spark), labels(spark, (1, 2))).count() == 0
    assert R.reading_levels(docs, labels(spark, (1, 2))).collect()[0]["band"] == 2


def test_held_out_accuracy(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    docs, rated = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/reading_labels.parquet").where("band is not null")
    learn, test = rated.where("doc_id % 3 <> 0"), rated.where("doc_id % 3 = 0").distinct().groupBy("doc_id").agg({"band": "avg"}).collect()
    got = {r["doc_id"]: r["level"] for r in R.reading_levels(docs, learn).collect()}
    errors = [abs(got[r["doc_id"]] - r["avg(band)"]) for r in test if r["doc_id"] in got]
    assert len(errors) > 8 and np.mean(errors) < 0.5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(-5, 5), st.integers(1, 4)), min_size=1, max_size=25))
def test_isotonic_is_rising_and_keeps_the_mean(points):
    x, y = np.array([p[0] for p in points]), np.array([p[1] for p in points], float)
    xs, ys = R.isotonic(x, y, np.ones(len(x)))
    assert (np.diff(ys) >= -1e-9).all() and (np.diff(xs) >= 0).all() and y.min() - 1e-9 <= ys.min() and ys.max() <= y.max() + 1e-9
