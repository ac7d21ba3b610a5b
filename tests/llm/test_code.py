"""Problems 1, 4 and 5: documented functions, files that do not parse, files nobody wrote by hand."""

import pytest

from siftwork.llm import documented_functions, generated_code, parse_failures

FILES = "file_id long, repo_id int, scan_id long, filepath string, size_bytes long, content string, name string, ok boolean, language string"
REPORTS = "scan_id long, repo_id int, parsed_count int, unsupported array<string>, failed array<struct<path:string,message:string>>, oversized array<string>"


def files(spark, *rows):
    """Extra columns have names that the operators use themselves."""
    return spark.createDataFrame([(i, 1, 1, path, len(text or ""), text, "clash", True, "clash") for i, path, text in rows], FILES)


def reports(spark, *rows):
    return spark.createDataFrame(list(rows), REPORTS)


GO = "package a\n\n// Drains the queue until no reader is left.\nfunc F() int {\n\treturn 1\n}\n\n// F2.\nfunc F2() {\n}\n"


def test_unparsable_files(spark):
    rows = [(1, "a.go", GO), (1, "a.go", GO), (2, "b.go", "package a\nfunc {"), (2, "b.go", "package a\nfunc {"), (3, "c.py", None), (4, "d.py", ""), (5, "e.zig", "((("), (6, None, "((("), (7, "f.js", "let a: number = 1;"), (8, "g.ts", "let a: number = 1;"), (9, "h.py", "x = 1\n" * 20_000), (10, "noext", "((")]
    got = parse_failures.unparsable(files(spark, *rows)).collect()
    assert sorted(r["file_id"] for r in got) == [2, 7]
    assert parse_failures.unparsable(files(spark)).count() == 0


def test_failure_rates(spark):
    rows = [(1, "a.go", GO), (2, "b.go", "func {"), (2, "b.go", "func {"), (3, "c.py", "(")]
    got = {r["language"]: r for r in parse_failures.failure_rates(files(spark, *rows), reports(spark, (1, 1, 3, ["x.zig"], [("b.go", ""), (None, None)], []), (1, 1, 3, ["x.zig"], [("b.go", ""), (None, None)], []), (2, 1, None, None, None, None))).collect()}
    assert (got["go"]["files"], got["go"]["failing"], got["go"]["rate"], got["go"]["failed_reported"], got["go"]["missed"]) == (2, 1, 0.5, 1, 0)
    assert (got["python"]["missed"], got["python"]["parsed_reported"], got["python"]["unsupported_reported"]) == (1, 3, 1)


def test_pairs(spark):
    py = '@d\ndef load_page(p):\n    """Loads the page."""\n\ndef load_page_2(p):\n    """Fails if the disk is full."""\n\n# TODO: document\ndef g(): pass\n\n# noqa\ndef h(): pass\n\nclass A:\n    """A class that tells much."""\n'
    broken = GO + "\nvar x = (\n\n// Waits for two clients.\nfunc Late() {\n}\n"
    rows = [(1, "a.go", GO), (1, "a.go", GO), (2, "b.py", py), (3, "c.go", broken), (4, "d.zig", GO), (5, "e.go", None), (6, "f.go", " ")]
    got = documented_functions.pairs(files(spark, *rows)).collect()
    assert sorted((r["file_id"], r["name"], r["parses"]) for r in got) == [(1, "F", True), (2, "load_page_2", True), (3, "F", False), (3, "Late", False)]
    assert next(r for r in got if r["file_id"] == 2)["summary"] == "Fails if the disk is full."
    assert documented_functions.pairs(files(spark)).count() == 0


def test_templates_are_found_by_their_count(spark):
    rows = [(i, f"f{i}.go", f"package a\n\n// Frobs things.\nfunc Zeta{chr(65 + i)}() {{\n}}\n") for i in range(20)] + [(99, "z.go", GO)]
    assert {r["file_id"] for r in documented_functions.pairs(files(spark, *rows), template_share=0.5).collect()} == {99}
    assert documented_functions.pairs(files(spark, *rows), template_share=0.99).count() == 21
    assert documented_functions.pairs(files(spark, *rows), template_share=0.5, template_words=1).count() == 21


def test_copies_of_a_file_make_no_template(spark):
    rows = [(i, f"v{i}/a.go", "package a\n\n// Assumes a sorted commit.\nfunc Join() {\n}\n") for i in range(20)] + [(99, "z.go", GO)] * 5
    got = documented_functions.pairs(files(spark, *rows), template_share=0.1).collect()
    assert sorted(r["file_id"] for r in got) == [*range(20), 99]


TRIVIAL = ["TBD", "", "###", "Function.", "Loads the page.", "loadPage()", "load page 7", "TODO write docs", "@param p\n@returns", "eslint-disable-next-line", "x = call(y);", "Copyright 2020 A B. MIT licence.", "@since 1.2", "==== helpers ------", "n/a", "Getter for page", "This function loads the page."]
TELLING = ["Null when the page is hidden.", "Liest die Datei.", "loadPage retries twice.", "@returns the number of free slots", "Safe to call twice."]


@pytest.mark.parametrize("text,expected", [(t, False) for t in TRIVIAL] + [(t, True) for t in TELLING])
def test_what_documentation_tells(text, expected):
    lines = documented_functions.clean(f"/** {text} */")
    assert (bool(lines) and documented_functions.informative(lines, "loadPage", "function loadPage ( p )")) == expected


def test_comment_markers():
    assert documented_functions.clean("/**\n * A b.\n *\n * @x y\n */") == ["A b.", "@x y"]
    assert documented_functions.clean("/// a\r\n//! b") == ["a", "b"]
    assert documented_functions.clean('r"""\n  A.\n\n  B\n"""') == ["A.", "B"]
    assert documented_functions.clean("# ----\n# x") == ["x"]


MIN = "var a=1,b=[2,3];" * 60
DATA = "x = [\n" + "    0.123456, 0.654321, 0.111111, 0.222222,\n" * 30 + "]\n"


def test_not_handwritten(spark):
    rows = [
        (1, "src/a.go", "// Code generated by x. DO NOT EDIT.\n" + GO), (2, "vendor/b/c.go", GO), (3, "dist/d.js", MIN), (4, "e.py", DATA), (5, "f.go", GO), (6, "g.go", None), (7, "h.go", None), (8, "src/vendor.go", GO), (9, "src/codegen/i.go", GO),
        (10, "j.go", GO.replace("F2.", "TODO Auto-generated method stub")), (11, "a_pb2.py", ""), (12, "vendor/x.zig", GO), (13, "lib/k.min.js", ""), (14, "lib/l.js", "/* x v1 */\n/* upstream: https://x.example */\nf()"), (1, "src/a.go", "// Code generated by x. DO NOT EDIT.\n" + GO), (15, None, GO),
        (16, "m.rs", "\n".join(f"pub fn get_{i}(m: &M) -> u32 {{\n    m.v[{i}]\n}}" for i in range(9))), (17, "third_party\\n.c", "int x;"),
    ]
    f = files(spark, *rows)
    r = reports(spark, (1, 1, 1, [], [], ["g.go"]), (2, 1, 1, None, None, None))
    got = {x["file_id"]: x["reasons"] for x in generated_code.not_handwritten(f, r).collect()}
    assert sorted(got) == [1, 2, 3, 4, 6, 11, 13, 14, 16, 17]
    assert got[1] == ["generated notice"] and got[3] == ["minified"] and "data" in got[4] and got[6] == ["oversized"] and got[14] == ["third-party notice"]
    assert sorted(x["file_id"] for x in generated_code.handwritten(f, r).collect()) == [5, 7, 8, 9, 10]
    assert generated_code.not_handwritten(files(spark), reports(spark)).count() == 0


def test_a_short_table_is_data():
    assert "data" in generated_code.reasons("T = [1.25, 2.5, 3.75, 4.125,\n 5.5, 6.25, 7.5, 8.75]\n")
    assert generated_code.reasons('NAME = "a fairly long description of this thing"\nN = 1\n') == []
    assert "minified" in generated_code.reasons("var a=b(c),d=e(f);" * 30)
    assert generated_code.reasons("a = b\n" * 11) == [] and generated_code.reasons("x = y\nf(z)\n" * 6) == ["evenly repeating"]


def test_size_alone_tells_an_oversized_file(spark):
    f = spark.createDataFrame([(1, 1, 1, "a.py", 20 * 2**20, None, "", True, "")], FILES)
    assert generated_code.not_handwritten(f, reports(spark)).count() == 1
