"""Problem 2: counts against brute force."""

from collections import Counter, defaultdict

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwork.llm import term_frequency as T

POSTINGS = "build_id long, repo_id int, segment_no int, term string, doc_id long, field_id byte, tf int, gram string, record int"


def postings(spark, *rows):
    return spark.createDataFrame([(b, 1, s, t, d, f, n, "clash", 0) for b, s, t, d, f, n in rows], POSTINGS)


def brute(texts, sigma):
    n, where = Counter(), defaultdict(set)
    for record, tokens in texts:
        for i in range(len(tokens)):
            for j in range(i + 1, min(i + sigma, len(tokens)) + 1):
                n[tuple(tokens[i:j])] += 1
                where[tuple(tokens[i:j])].add(record)
    return {g: (n[g], len(where[g])) for g in n}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), min_size=1, max_size=12), st.integers(1, 4))
def test_ngrams_against_brute_force(spark, texts, sigma):
    rows = list(enumerate(texts))
    got = T.ngrams(spark.createDataFrame(rows, "id long, toks array<string>").repartition(3), "id", "toks", sigma).collect()
    assert {tuple(r["gram"]): (r["occurrences"], r["records"]) for r in got} == brute(rows, sigma)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("ab"), min_size=1, max_size=3), st.integers(0, 3), st.sampled_from([None, 1, 2])), max_size=40), st.integers(1, 7), st.integers(1, 3))
def test_batches_of_any_size_count_alike(rows, size, sigma):
    rows = sorted(((tuple(s[:sigma]), r, d) for s, r, d in rows), key=lambda x: (x[1], x[2] is not None, x[2] or 0))
    rows.sort(key=lambda x: x[0], reverse=True)  # stable, but reversed among equals
    rows = [x for s in sorted({r[0] for r in rows}, reverse=True) for x in sorted((r for r in rows if r[0] == s), key=lambda x: (x[1], x[2] is not None, x[2] or 0))]
    schema = pa.schema([("suffix", pa.list_(pa.string())), ("record", pa.int64()), ("weight", pa.int64()), ("delivery", pa.int64())])
    batches = [pa.RecordBatch.from_pylist([{"suffix": list(s), "record": r, "weight": 2, "delivery": d} for s, r, d in rows[i : i + size]], schema) for i in range(0, len(rows), size)]
    got = {tuple(g): (n, k) for b in T._count(batches) for g, n, k in zip(*(b.column(c).to_pylist() for c in range(3)))}
    once = [x for i, x in enumerate(rows) if x[2] is None or i == 0 or rows[i - 1] != x]
    expected = {}
    for s, r, _ in once:
        for j in range(1, len(s) + 1):
            n, where = expected.setdefault(s[:j], [0, set()])
            expected[s[:j]][0] = n + 2
            where.add(r)
    assert got == {g: (n, len(w)) for g, (n, w) in expected.items()}


def test_a_term_in_every_record_is_spread_over_salts(spark, monkeypatch):
    monkeypatch.setattr(T, "RECORDS_PER_SALT", 10)
    rows = [(i, ["hot", f"w{i}"]) for i in range(300)]
    got = {tuple(r["gram"]): (r["occurrences"], r["records"]) for r in T.ngrams(spark.createDataFrame(rows, "id long, toks array<string>"), "id", "toks", 2).collect()}
    assert got == brute(rows, 2)


def test_marks(spark):
    rows = [(1, 0, "Cafe\u0301 ", d, 1, 1) for d in range(4)] + [(1, 0, "caf\u00e9", 0, 1, 5), (1, 0, "caf\u00e9", 0, 1, 5), (1, 1, "caf\u00e9", 0, 1, 2)]
    rows += [(1, 0, "once", 5, 1, 1), (1, 0, None, 6, 1, 9), (1, 0, "two\u00a0", 7, 1, 2), (1, 0, "TWO", 8, 1, 2), (1, 0, "null tf", 9, 1, None)]
    got = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in T.term_frequencies(postings(spark, *rows)).collect()}
    assert got == {"caf\u00e9": (11, 4, "common"), "once": (1, 1, "rare"), "two": (4, 2, None)}


def test_rare_comes_before_common_and_the_bounds_count(spark):
    rows = [(1, 0, "x", 1, 0, 3), (1, 0, "y", 1, 0, 4), (1, 0, "z", 2, 0, 4), (1, 0, "z", 3, 0, 4), (1, 0, "z", 4, 0, 4)] + [(1, 0, None, d, 0, 1) for d in range(5, 11)]
    got = {r["term"]: r["mark"] for r in T.term_frequencies(postings(spark, *rows)).collect()}
    assert got == {"x": "rare", "y": None, "z": "common"}


def test_empty_table(spark):
    assert T.term_frequencies(postings(spark)).count() == 0
    assert T.ngrams(spark.createDataFrame([(1, None), (2, []), (3, [None])], "id long, toks array<string>"), "id", "toks", 2).count() == 0
