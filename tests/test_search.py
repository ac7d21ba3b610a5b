"""Index and search: golden scores, filters, properties, stored indexes."""

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from siftwork.functions import text as X
from siftwork.operators import index, search
from siftwork.schemas import COMMENT, EXPORT

SYMBOL = f"doc_id long, name string, kind string, filepath string, start_line int, end_line int, params array<string>, comment {COMMENT.simpleString()}, export {EXPORT.simpleString()}"
SECTION = "doc_id long, filepath string, section_title string, heading_hierarchy array<string>, content string, code_symbols array<string>, start_line int, end_line int"


def code(spark, *pairs):
    rows = [(i, name, "Function", path, 1, 10, [], None, None) for i, name, path in pairs]
    return index.code_documents(spark.createDataFrame(rows, SYMBOL))


def docs(spark, *rows):
    return index.doc_documents(spark.createDataFrame([(i, path, title, [], text, [], 1, 20) for i, title, text, path in rows], SECTION))


@pytest.fixture(scope="module")
def mixed(spark):
    c = code(spark, (0, "validateToken", "src/auth.rs"), (1, "handler", "examples/auth/login.ts"))
    d = docs(spark, (2, "Authentication", "JWT token validation guide", "docs/auth.md"))
    return index.build(c.unionByName(d))


def hits(df):
    return [(r["doc_id"], r["score"]) for r in df.collect()]


def test_code_only_scores(spark):
    i = index.build(code(spark, *((n, f"parse{x}", f"src/{x.lower()}.rs") for n, x in enumerate(("JSON", "XML", "CSV")))))
    assert [(d, f"{s:.8f}"[:10]) for d, s in hits(search.search(i, "parse"))] == [(n, "0.53412557"[:10]) for n in range(3)]


def test_mixed_scores(mixed):
    got = hits(search.search(mixed, "validate token authentication"))
    assert [d for d, _ in got] == [2, 0]
    assert got[0][1] == pytest.approx(6.2502913, abs=1e-6) and got[1][1] == pytest.approx(3.1215336, abs=1e-6)


def test_limits_and_empty_queries(mixed):
    assert hits(search.search(mixed, "token", 0)) == [] and hits(search.search(mixed, "! a")) == [] and hits(search.search(mixed, "")) == []
    assert len(hits(search.search(mixed, "token", 1))) == 1


def test_repeated_words_count_twice(mixed):
    one, two = hits(search.search(mixed, "token")), hits(search.search(mixed, "token token"))
    assert [d for d, _ in one] == [d for d, _ in two]
    assert two[0][1] == pytest.approx(2 * one[0][1], rel=1e-6)


def test_filters_leave_statistics_alone(mixed):
    every = dict(hits(search.search(mixed, "token auth login")))
    for only in (search.Filters.of(doc_type="Code"), search.Filters.of(["examples"]), search.Filters.of(exts=["RS,.ts"]), search.Filters.of(["docs", "src"], ["md"], "Doc")):
        got = dict(hits(search.search(mixed, "token auth login", filters=only)))
        assert got and all(every[d] == s for d, s in got.items())
    assert hits(search.search(mixed, "token", filters=search.Filters.of(["sr"]))) == []
    assert hits(search.search(mixed, "token", filters=search.Filters.of(["src/auth.rs"]))) == []


def test_search_many_equals_one_by_one(spark, mixed):
    queries = spark.createDataFrame([(1, "token"), (2, "auth login"), (3, "")], "query_id int, query string")
    many = search.search_many(mixed, queries, 2)
    for q in queries.collect():
        assert sorted((r["doc_id"], r["score"]) for r in many.where(f"query_id = {q[0]}").collect()) == sorted(hits(search.search(mixed, q[1], 2)))


def test_identifiers_in_queries(spark, mixed):
    q = spark.createDataFrame([(0, "validateToken")], "query_id int, query string")
    assert search.query_terms(q).count() == 1
    assert [r["term"] for r in search.query_terms(q, identifiers=True).orderBy("qpos").collect()] == ["valid", "token"]


def test_custom_weights(mixed):
    a, b = hits(search.search(mixed, "token", weights=(8.0, 4.0, 3.0, 2.0))), hits(search.search(mixed, "token"))
    assert [(d, pytest.approx(2 * s)) for d, s in b] == a
    assert all(s == 0 for _, s in hits(search.search(mixed, "token", weights=())))


def test_stored_index(spark, mixed, tmp_path):
    mixed.save(str(tmp_path), 2)
    again = index.Index.load(spark, str(tmp_path))
    assert hits(search.search(again, "validate token")) == hits(search.search(mixed, "validate token"))


def explained(df, capsys):
    df.explain("formatted")
    return capsys.readouterr().out


def test_scans_are_asked_for_the_terms(spark, mixed, tmp_path, capsys):
    mixed.save(str(tmp_path), 2)
    loaded = index.Index.load(spark, str(tmp_path))
    plan = explained(search.search(loaded, "validate token", 5), capsys)
    pushed = [x for x in plan.splitlines() if x.startswith("PushedFilters") and "In(term" in x]
    assert pushed and "valid" in pushed[0] and "token" in pushed[0]
    queries = spark.createDataFrame([(1, "validate token"), (2, "guide")], "query_id int, query string")
    plan = explained(search.scores(loaded, search.query_terms(queries)), capsys)
    assert any("In(term" in x and "guid" in x for x in plan.splitlines() if x.startswith("PushedFilters"))
    # what is broadcast are the query terms: the postings, on the left, are read where they are
    search.scores(loaded, search.query_terms(queries)).explain()
    tree = capsys.readouterr().out.splitlines()
    joins = [x for x in tree if "Join [" in x]
    scan, sent = (next(i for i, x in enumerate(tree) if mark in x) for mark in ("FileScan parquet [term#", "BroadcastExchange"))
    assert len(joins) == 1 and "BroadcastHashJoin" in joins[0] and "BuildRight" in joins[0] and "doc_id#" in tree[scan] and scan < sent


@settings(max_examples=25, deadline=None)
@given(st.text(st.sampled_from("abZ019_ -.éß/\n"), max_size=30))
def test_words_of_a_query_are_those_of_a_text(spark, query):
    rows = search.query_terms(spark.createDataFrame([(0, query)], "query_id int, query string")).orderBy("qpos").collect()
    assert search.driver_terms(spark, query) == [r["term"] for r in rows]


def test_many_terms_are_joined_by_a_shuffle(spark, mixed, monkeypatch, capsys):
    queries = spark.createDataFrame([(1, "validate token"), (2, "guide"), (3, "login token token"), (4, "")], "query_id int, query string")
    rows = lambda: sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in search.search_many(mixed, queries, 2).collect())
    few = rows()
    monkeypatch.setattr(search, "PUSHED_TERMS", 1)
    assert rows() == few and len(few) > 3
    monkeypatch.setattr(search, "BROADCAST_TERMS", 1)
    assert rows() == few
    assert "SortMergeJoin" in explained(search.scores(mixed, search.query_terms(queries)), capsys)


def test_hits_of_many_queries_are_not_shuffled(spark, mixed, tmp_path, capsys):
    queries = spark.createDataFrame([(1, "validate token"), (2, "guide"), (3, "login token token"), (4, "")], "query_id int, query string")
    plan = explained(search.search_many(mixed, queries, 2), capsys)
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id", plan) and "MapInArrow" in plan
    # neither are the postings of an index that is being built
    c = code(spark, (0, "validateToken", "src/auth.rs"))
    assert "Exchange" not in explained(index.build(c, stored=False).postings, capsys) + explained(index.build(c).postings, capsys)
    mixed.save(str(tmp_path), 2)
    loaded = index.Index.load(spark, str(tmp_path))
    for only in (search.Filters(), search.Filters.of(["src", "docs"]), search.Filters.of(doc_type="Code")):
        one, two = (sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in search.search_many(i, queries, 2, only).collect()) for i in (mixed, loaded))
        assert one == two and one


def test_best_of_rows_against_all_scores(monkeypatch):
    """Ties, repeated words, documents that batches cut, fewer hits than k, queries that add up in another order."""
    monkeypatch.setattr(search, "SCORED_ROWS", 40)
    draw = np.random.default_rng(3)
    rows = [(d, w * 128 + f, np.float32(draw.choice([0.1, 0.25, 1.7, 3.3]))) for d in draw.permutation(300).tolist() for w, f in itertools.product(range(4), range(3)) if draw.random() < (0.5, 0.2, 0.05, 0.002)[w]]
    asked = [[0], [0, 1], [1, 0], [0, 0, 2], [3], [2, 1, 0, 3]]
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "key": pa.array([r[1] for r in rows], pa.int64()), "s": pa.array([r[2] for r in rows], pa.float32())})
    for k in (1, 3, 1000):
        run = search._best_of_rows(np.array(sum(asked, []), np.int32), np.cumsum([len(q) for q in asked]), k)
        got = pa.Table.from_batches(run(iter(table.to_batches(max_chunksize=17)))).to_pylist()
        for i, q in enumerate(asked):
            total = {}
            for w in q:
                for d, key, s in sorted(rows, key=lambda r: r[1]):
                    if key // 128 == w:
                        total[d] = np.float32(total.get(d, np.float32(0)) + s)
            assert [(r["doc_id"], r["score"]) for r in got if r["number"] == i] == sorted(((d, float(s)) for d, s in total.items()), key=lambda x: (-x[1], x[0]))[:k]


def test_terms_are_counted_within_a_row(spark):
    rows = [(0, [["a", "b", "a"], None, []]), (1, []), (2, [None]), (3, [["tokens", "é", "token"], ["a"]])]
    df = spark.createDataFrame(rows, "i int, f array<array<string>>").repartition(1)
    for counts, words in ((X.term_counts, lambda w: w), (X.stem_counts, lambda w: w.removesuffix("s"))):
        got = {r["i"]: [f and (f["dl"], dict(f["terms"])) for f in r["c"]] for r in df.select("i", counts("f").alias("c")).collect()}
        assert got == {i: [f if f is None else (len(f), dict(Counter(map(words, f)))) for f in fields] for i, fields in rows}


def test_nulls_and_empty_tables(spark):
    rows = [Row(doc_id=0, name=None, kind=None, filepath=None, start_line=None, end_line=None, params=None, comment=None, export=None), Row(doc_id=1, name="x" * 200_000, kind="Function", filepath="a.py", start_line=1, end_line=1, params=[None, "tokenName"], comment=None, export=None)]
    i = index.build(index.code_documents(spark.createDataFrame(rows, SYMBOL)).unionByName(docs(spark, (2, None, None, None), (3, "", "", ""))))
    assert [d for d, _ in hits(search.search(i, "token"))] == [1]
    empty = index.build(code(spark).unionByName(docs(spark)))
    assert hits(search.search(empty, "token")) == [] and empty.doc_freqs.count() == 0


def test_numbers_follow_the_order_and_not_the_partitions(spark):
    rows = [(f"p{i % 7}", i) for i in range(200)]
    a = index.numbered(spark.createDataFrame(rows, "k string, v int").repartition(5), "k", "v")
    b = index.numbered(spark.createDataFrame(rows[::-1], "k string, v int").repartition(2), "k", "v")
    assert sorted(a.collect()) == sorted(b.select(*a.columns).collect())
    assert [r["doc_id"] for r in a.orderBy("k", "v").collect()] == list(range(200))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.from_regex(r"[a-z]{2,5}[A-Z][a-z]{2,5}", fullmatch=True), st.from_regex(r"[a-z]{1,3}/[a-z]{1,5}\.[a-z]{1,3}", fullmatch=True)), min_size=1, max_size=12), st.from_regex(r"[a-z]{2,6}( [a-z]{2,6}){0,2}", fullmatch=True))
def test_results_are_sorted_limited_and_not_negative(spark, pairs, query):
    i = index.build(code(spark, *((n, *p) for n, p in enumerate(pairs))))
    got = hits(search.search(i, query + " " + pairs[0][0][:3].lower(), 5))
    assert len(got) <= 5 and all(s >= 0 for _, s in got)
    assert got == sorted(got, key=lambda x: (-x[1], x[0]))


def test_order_of_rows_does_not_matter(spark):
    rows = [(n, f"token{n % 3} shared words", f"text {n % 2} shared", f"d/{n}.md") for n in range(30)]
    results = []
    for order, parts in itertools.product((rows, rows[::-1]), (1, 5)):
        i = index.build(docs(spark, *order).repartition(parts))
        results.append(hits(search.search(i, "shared text token1", 12)))
    assert all(r == results[0] for r in results)
