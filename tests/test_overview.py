"""Test links, cards, re-exports, coverage and hints."""

import random

from siftwork.functions import text as X
from siftwork.functions.stemming import stem
from siftwork.operators import overview as O
from siftwork.schemas import COMMENT, EXPORT, MODULE_RULES

SYMBOL = f"repo_id int, symbol_id long, name string, kind string, filepath string, start_line int, end_line int, params array<string>, signature_preview string, comment {COMMENT.simpleString()}, export {EXPORT.simpleString()}, ordinal int"
REEXPORT = "repo_id int, reexport_id long, filepath string, start_line int, end_line int, local_name string, exported_name string, source_specifier string, is_type_only boolean, ordinal int"


def symbols(spark, *rows):
    made = []
    for n, (name, kind, path, *more) in enumerate(rows):
        public, export, summary, flags, repo = (list(more) + ["Public", "Named", None, [], 1][len(more) :])[:5]
        comment = (summary, None, flags, "JsDoc", "SummaryOnly") if summary else None
        made.append((repo, n, name, kind, path, n + 1, n + 2, ["a", "b"], f"{name}(a, b)" if kind == "Function" and n % 2 == 0 else None, comment, (public, export, None), n))
    return spark.createDataFrame(made, SYMBOL)


def brute(rows, k=3):
    """Every symbol against every test, by the rules as they are stated."""

    def words(name):
        import re

        parts = re.split(r"[_\-./]|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", name)
        return [stem(p.lower()) for p in parts if len(p.encode()) > 1]

    def file_stem(path):
        return path.split("/")[-1].split(".")[0].replace("_test", "").replace("_spec", "")

    def folder(path):
        return path.rpartition("/")[0]

    out = {}
    for n, (name, kind, path) in enumerate(rows):
        if kind != "Function":
            continue
        found = []
        for t, (tname, _, tpath) in enumerate(rows):
            low = tpath.lower()
            if not (any(m in low for m in ("/tests/", "/test/", ".test.", "_test.")) or tname.startswith("test")):
                continue
            reasons = [r for r, ok in (("TestPathMatch", all(w in low for w in words(name))), ("TestNameMatch", set(words(name)) <= set(words(tname))), ("FileStemMatch", file_stem(path) == file_stem(tpath)), ("DirectoryProximity", folder(path) != "" and folder(path) == folder(tpath))) if ok]
            if reasons:
                found.append((-len(reasons), tpath, f"test:{tpath}#{tname}@L{t + 1}", t, tuple(reasons)))
        out[n] = [(f[3], list(f[4])) for f in sorted(found)[:k]]
    return {n: v for n, v in out.items() if v}


def test_links_against_brute_force(spark):
    for seed in range(3):
        r = random.Random(seed)
        vocab = ["load", "loading", "page", "Index", "x", "tree", "go"]
        rows = [("".join(w.capitalize() if i else w for i, w in enumerate(r.sample(vocab, r.randint(1, 3)))) if r.random() < 0.9 else "_", "Function", f"{r.choice(['src', 'src/tests', 'lib', 'a/test'])}/{r.choice(['load', 'page_test', 'go.test', 'tree'])}.py".replace("lib/", "" if r.random() < 0.3 else "lib/")) for _ in range(60)]
        rows += [("test_load_page", "Function", "x/tests/load_page.py"), ("testTree", "Function", "q.py")]
        s = symbols(spark, *rows)
        got = O.test_links(s, s.where(X.is_test_candidate("name", "filepath")), "symbol_id", "repo_id").collect()
        mine = {}
        for g in sorted(got, key=lambda g: (g["id"], g["rank"])):
            mine.setdefault(g["id"], []).append((g["test_id"], g["reasons"]))
        assert mine == brute(rows)


def report(spark, s, *reexports, rules=None, **budget):
    r = spark.createDataFrame(list(reexports), REEXPORT)
    return O.overview(s, r, "symbol_id", "reexport_id", "repo_id", rules=rules, budget=O.Budget(**budget))


def test_hot_repository_of_one_name(spark):
    """Thousands of functions of one name, stem and folder: three links each, and as few rows before them."""
    n = 3000
    s = symbols(spark, *(("get", "Function", f"src/d{i % 3}/index.ts") for i in range(n)), *(("testGet", "Function", f"src/d{i % 3}/index.test.ts") for i in range(n)))
    apis, tests = s.where("name = 'get'"), s.where(X.is_test_candidate("name", "filepath"))
    got = O.test_links(apis, tests, "symbol_id", "repo_id").collect()
    assert len(got) == 3 * n and {g["rank"] for g in got} == {1, 2, 3}
    assert all(g["reasons"] == ["TestNameMatch", "FileStemMatch", "DirectoryProximity"] for g in got)


def test_names_are_compared_by_stems_and_a_symbol_may_be_its_own_test(spark):
    s = symbols(spark, ("validateToken", "Function", "src/a.ts"), ("test_validation_of_tokens", "Function", "x/b_test.rs", "Private", "None"), ("testAll", "Function", "y.ts"))
    links = {(r["id"], r["test_id"], tuple(r["reasons"])) for r in O.test_links(s, s.where(X.is_test_candidate("name", "filepath")), "symbol_id", "repo_id").collect()}
    assert (0, 1, ("TestNameMatch",)) in links and (2, 2, ("TestNameMatch", "FileStemMatch")) in links


def test_surface_falls_back_to_unknown_only_where_nothing_is_public(spark):
    s = symbols(
        spark, ("a", "Function", "a.ts"), ("b", "Function", "b.ts", "Unknown"), ("c", "Class", "c.ts", "Unknown", "None", None, [], 2), ("d", "Method", "d.ts", "Public", "None", None, [], 2), ("e", "Function", "e.ts", "Private", "None", None, [], 2),
        ("f", "Function", "f.ts", "Unknown", "None", None, [], 3), ("g", "Function", "g.ts", "Private", "None", None, [], 3),
    )
    o = report(spark, s, (3, 0, "index.ts", 1, 1, "g", "shown", "./g", False, 0))
    assert {(r["repo_id"], r["name"], r["surface"]) for r in o.cards.collect()} == {(1, "a", "api"), (2, "c", "type"), (3, "shown", "api")}
    notes = {r["repo_id"]: r["notes"] for r in o.meta.collect()}
    assert O.NOTES["fallback"] in notes[2] and O.NOTES["fallback"] not in notes[3]


def test_a_reexported_private_function_has_its_tests(spark):
    s = symbols(spark, ("hid", "Function", "src/a.ts", "Private", "None"), ("test_hid", "Function", "t/tests/b.ts", "Private", "None"))
    o = report(spark, s, (1, 0, "src/index.ts", 1, 1, "hid", "shown", "./a", False, 0))
    (card,) = o.cards.collect()
    assert (card["name"], card["score"], [t["test_name"] for t in card["tests"]]) == ("shown", 4.6, ["test_hid"])


def test_namespace_cards(spark):
    s = symbols(spark, ("f", "Function", "src/a.ts"))
    o = report(spark, s, (1, 0, "src/index.ts", 4, 4, "*", "ns", "./a", False, 0), (1, 1, "src/index.ts", 5, 5, "*", "own", None, False, 1))
    cards = {r["name"]: r for r in o.shown.collect()}
    assert (cards["ns"]["ref"], cards["ns"]["kind"], cards["ns"]["score"], cards["ns"]["summary"], cards["ns"]["signature"]) == ("type:src/index.ts#ns@L4", "Module", 2.1, "namespace re-export from ./a", "ns")
    assert cards["own"]["summary"] is None and cards["own"]["flags"] == []


def test_coverage_counts_all_symbols_and_the_shown_apis(spark):
    s = symbols(
        spark, ("a", "Function", "a.ts", "Public", "Named", "Says."), ("b", "Class", "b.ts", "Unknown"), ("testA", "Function", "a.ts", "Private", "None", "Says."),
        ("c", "Function", "c.ts", "Private", "None", "Says.", [], 2), ("m", "Method", "c.ts", "Unknown", "None", None, [], 2), ("d", "Const", "d.ts", "Public", "Named", None, [], 3),
    )
    got = {r["repo_id"]: (r["publicness"], r["comments"], r["tests"], r["notes"], r["truncated"]) for r in report(spark, s).meta.collect()}
    assert got == {1: ("Partial", "Partial", "Complete", [O.NOTES["publicness"], O.NOTES["comments"]], False), 2: ("Complete", "Complete", "Unsupported", [], False), 3: ("Unsupported", "Unsupported", "Unsupported", [], False)}


def test_budgets(spark):
    s = symbols(spark, *((f"f{i}", "Function", f"f{i}.ts") for i in range(4)), *((f"T{i}", "Class", f"t{i}.ts") for i in range(3)))
    o = report(spark, s, apis=3, types=2, hints=2)
    assert [(r["surface"], r["rank"]) for r in o.shown.orderBy("surface", "rank").collect()] == [("api", 1), ("api", 2), ("api", 3), ("type", 1), ("type", 2)]
    assert o.hints.count() == 2 and o.meta.collect()[0]["truncated"] and O.NOTES["truncated"] in o.meta.collect()[0]["notes"]
    assert not report(spark, s).meta.collect()[0]["truncated"]
    assert report(spark, s.where("false")).meta.count() == 0


def test_reexports(spark):
    s = symbols(
        spark, ("createSession", "Function", "src/auth.ts"), ("Session", "Interface", "src/session/index.ts"), ("main", "Function", "src/auth.ts", "Public", "Default"), ("hidden", "Function", "src/auth.ts", "Private", "None"), ("util", "Function", "packages/web/src/util.ts"), ("createSession", "Function", "src/auth.cjs"), ("createSession", "Function", "nowhere/far.ts")
    )
    rows = [
        (1, 0, "src/index.ts", 1, 1, "createSession", "open", "./auth", False, 0), (1, 1, "src/index.ts", 2, 2, "Session", "UserSession", "./session", True, 1), (1, 2, "src/index.ts", 3, 3, "default", "run", "./auth.ts", False, 2), (1, 3, "src/index.ts", 4, 4, "*", "*", "./auth.ts", False, 3),
        (1, 9, "packages/web/a.ts", 2, 2, "createSession", "far", "lib/far", False, 1), (1, 4, "src/index.ts", 5, 5, "*", "ns", "./auth", False, 4), (1, 5, "src/index.ts", 6, 6, "createSession", "x", "./auth.js", False, 5), (1, 6, "packages/web/a.ts", 1, 1, "util", "u", "@/util", False, 0), (1, 7, "src/index.ts", 7, 7, "gone", "g", None, False, 6), (2, 8, "src/index.ts", 1, 1, "createSession", "open", "./auth", False, 0),
    ]
    r = spark.createDataFrame(rows, REEXPORT)
    rules = spark.createDataFrame([("", "", "@/*", ["nowhere/*"]), ("", "", "lib/*", ["nowhere/*"]), ("packages/web", "packages/web", "@/*", ["packages/web/src/*"])], MODULE_RULES)
    got = {(x["rid"], x["sid"], x["exported_name"]) for x in O.resolved_reexports(r, s, "reexport_id", "symbol_id", "repo_id", rules=rules).collect()}
    assert got == {(0, 5, "open"), (1, 1, "UserSession"), (2, 2, "run"), (3, 0, "createSession"), (6, 4, "u"), (9, 6, "far")}
    assert O.resolved_reexports(r.where("false"), s, "reexport_id", "symbol_id", "repo_id").count() == 0


def test_cards(spark):
    s = symbols(
        spark, ("validateToken", "Function", "src/auth.ts", "Public", "Named", "Checks. ", ["Deprecated"]), ("Session", "Interface", "src/s.ts"), ("demo", "Function", "lib/examples/demo.ts"), ("test_validate_token", "Function", "tests/auth_test.rs", "Private", "None")
    )
    o = report(spark, s, (1, 0, "src/index.ts", 1, 1, "validateToken", "check", "./auth", False, 0), apis=2)
    got = {x["name"]: x for x in o.cards.collect()}
    assert {k: v["score"] for k, v in got.items()} == {"validateToken": 5.0, "Session": 2.0, "demo": 2.3, "check": 5.1}
    assert got["check"]["ref"] == "api:src/index.ts#check@L1" and got["check"]["signature"] == "check(a, b)" and got["check"]["publicness"] == "Reexported" and got["check"]["flags"] == ["Deprecated"]
    assert got["validateToken"]["signature"] == "validateToken(a, b)" and got["Session"]["signature"] == "Session"
    assert [x["name"] for x in o.shown.where("surface = 'api'").orderBy("rank").collect()] == ["check", "validateToken"]
    tests = o.tests.collect()
    assert [(t["test_path"], t["test_name"], t["linked_symbols"], t["reasons"], t["score"]) for t in tests] == [("tests/auth_test.rs", "test_validate_token", ["api:src/index.ts#check@L1", "api:src/auth.ts#validateToken@L1"], ["TestNameMatch", "FileStemMatch"], 2.5)]
    hints = [(h["rank"], h["action"], h["label"], h["reason"]) for h in o.hints.orderBy("rank").collect()]
    assert hints == [(1, "InspectSymbol", "check(a, b)", "top public API"), (2, "InspectSymbol", "validateToken(a, b)", "top public API"), (3, "InspectSymbol", "Session", "top public type"), (4, "ReadPath", "test_validate_token", "top linked test")]
    assert [(c["publicness"], c["comments"], c["tests"], c["truncated"]) for c in o.meta.collect()] == [("Complete", "Partial", "Complete", True)]
