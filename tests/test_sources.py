"""Scans, module configs, stored artifacts, the engine end to end, the command line and the stream."""

import io
import json
import os
import subprocess

import pytest

from siftwork import cli
from siftwork.operators import search
from siftwork.operators.search import Filters
from siftwork.plans.engine import Engine, stored_engine, stored_index
from siftwork.sources import artifacts, clone, files, module_config
from siftwork.sources.store import Store
from siftwork.streaming import incremental

SAMPLE = {
    "src/auth.ts": "/** Checks a token. */\nexport function validateToken(token: string, secret: string): boolean {\n  return token === secret;\n}\n\nexport interface Session {\n  id: string;\n}\n",
    "src/index.ts": "export { validateToken as createSession } from './auth';\nexport type { Session as UserSession } from './auth';\n",
    "src/session.rs": "/// Holds entries.\npub struct Ledger {\n    id: u32,\n}\n\nimpl Ledger {\n    pub fn refresh(&self) -> u32 {\n        self.id\n    }\n}\n",
    "examples/demo.ts": "export function demoLogin(token: string) {\n  return token;\n}\n",
    "tests/auth_test.rs": "fn validate_token_works() {\n    assert!(true);\n}\n",
    "docs/guide.md": "# Guide\n\n## Tokens\n\n### Opening\n\nHow a JWT is checked before a session opens.\n\n```ts\nopen(a, b)\n```\n\n## Refresh token usage\n\nCall it again.\n\n```ts\nrefresh()\n```\n",
    "notes.txt": "nothing\n",
}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("sample repo+x")
    for path, text in SAMPLE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


@pytest.fixture(scope="module")
def engine(spark, repo):
    return Engine.from_dir(spark, str(repo))


def test_scan(spark, tmp_path):
    for path, data in {"a.py": b"x", ".hidden": b"x", ".git/b.py": b"x", "build/c.py": b"x", "bad.py": b"\xff\xfe", "d.log": b"x", "big.py": b"x" * (files.SIZE_LIMIT + 1), "edge.py": b"y" * files.SIZE_LIMIT}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(data)
    (tmp_path / ".gitignore").write_text("build/\n*.log\n# no\n")
    got = {r["filepath"]: (r["is_oversized"], r["content"] is None) for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {"a.py": (False, False), "edge.py": (False, False), "big.py": (True, True)}


def test_ignore_files(spark, tmp_path):
    for path in ("a.log", "keep.log", "sub/b.log", "sub/c.tmp", "c.tmp", "sub/deep/x.py", "deep/x.py", "doc/a/b/c.txt", "secret.py", "out1.py", "outx.py", "sub/data/y.py"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    (tmp_path / ".git/info").mkdir(parents=True)
    (tmp_path / ".git/info/exclude").write_text("secret.py\n")
    (tmp_path / ".gitignore").write_text("*.log\n!keep.log\n/deep/\ndoc/**/c.txt\nout[0-9].py\n\n# note\n")
    (tmp_path / "sub/.gitignore").write_text("*.tmp\n!b.log\ndata/\n")
    assert sorted(r["filepath"] for r in files.scan(spark, str(tmp_path)).collect()) == ["c.tmp", "keep.log", "outx.py", "sub/b.log", "sub/deep/x.py"]


def test_report(engine):
    (r,) = engine.report().collect()
    assert (r["parsed_count"], r["unsupported"], r["failed"], r["oversized"]) == (6, ["notes.txt"], [], [])


def test_sections_and_ranking(engine):
    assert [r["section_title"] for r in engine.sections.orderBy("ordinal").collect()] == ["Opening", "Refresh token usage"]
    hits = engine.search("validate token jwt session").collect()
    assert (hits[0]["filepath"], hits[0]["name"]) == ("src/auth.ts", "validateToken")
    assert any(h["section"] == "Opening" for h in hits)


def test_filters(engine):
    code = engine.search("demo sign in token", filters=Filters.of(["examples"], ["ts"], "Code")).collect()
    assert [(h["name"], h["is_example"]) for h in code] == [("demoLogin", True)]
    docs = engine.search("refresh the token again", filters=Filters.of(["docs"], ["md"], "Doc")).collect()
    assert {h["doc_type"] for h in docs} == {"Doc"} and "Refresh token usage" in [h["section"] for h in docs]


def test_overview(engine):
    o = engine.overview()
    cards = {r["name"]: r for r in o.shown.collect()}
    assert cards["validateToken"]["signature"] == "validateToken(token, secret)" and cards["createSession"]["signature"] == "createSession(token, secret)"
    assert {"Session", "UserSession"} <= set(cards)
    assert [t["test_name"] for t in cards["createSession"]["tests"]] == ["validate_token_works"]
    assert "tests/auth_test.rs" in [r["test_path"] for r in o.tests.collect()]
    assert any("validateToken" in r["target"] or "createSession" in r["target"] for r in o.hints.collect())
    assert [tuple(r)[1:4] for r in o.meta.collect()] == [("Complete", "Partial", "Partial")]


def test_rows_in_memory(spark):
    e = Engine.from_rows(spark, [("a.ts", "export function loadPage() {}\n"), ("b.md", "# Load\npages\n")])
    assert {r["doc_type"] for r in e.search("load").collect()} == {"Code", "Doc"} and e.doc_count == 2
    assert Engine.from_rows(spark, []).search("load").count() == 0
    more = e.add([("a.ts", "export function savePage() {}\nexport function dropPage() {}\n"), ("c.py", "def load(): pass\n")])
    assert more.doc_count == 4 and {r["name"] for r in more.search("page load").collect() if r["name"]} == {"savePage", "dropPage", "load"}


def said(spark, *args):
    out = io.StringIO()
    assert cli.main([*map(str, args)], spark, out) == 0
    return out.getvalue()


def test_command_line(spark, repo):
    lines = [json.loads(x) for x in said(spark, "search", repo, "validate token", "-n", "2").splitlines()]
    assert len(lines) == 2 and all(len(x) == 1 for x in lines) and "Code" in lines[0]
    assert said(spark, "search", repo, "jwt session", "-f", "text", "--type", "doc").startswith('[doc]  docs/guide.md#Opening  "')
    report = json.loads(said(spark, "overview", repo))
    assert list(report) == ["meta", "public_apis", "public_types", "public_api_tests", "entry_hints"] and report["meta"]["coverage"]["test_linkage"] == "Partial"
    assert report["public_apis"][0]["tests"][0]["display_name"] == "validate_token_works" and {t["comment_summary"] for t in report["public_types"]} == {None, "/ Holds entries."}
    assert report["entry_hints"][0]["reason"] == "top public API" and report["entry_hints"][-1]["action"] == "ReadPath"
    text = said(spark, "overview", repo, "-f", "text").splitlines()
    heads = ["public_api:", "public_types:", "public_api_tests:", "entry_hints:"]
    assert text[0].startswith("repo: ") and [x for x in text if x in heads] == heads and "    tests: validate_token_works" in text
    with pytest.raises(ValueError):
        cli.main(["search", str(repo), "日本"], spark, io.StringIO())


def commit_all(folder):
    for args in (["init", "-q"], ["add", "-A"], ["-c", "user.name=a", "-c", "user.email=a@b", "commit", "-qm", "x"]):
        subprocess.run(["git", "-C", str(folder), *args], check=True)


def test_command_line_uses_what_is_stored(spark, tmp_path, monkeypatch, capsys):
    root = tmp_path / "siftwork"
    monkeypatch.setenv("SIFTWORK_CACHE_DIR", str(root))
    folder = artifacts.artifact_dir(artifacts.Spec("o", "r")) / "clone"
    for path, text in SAMPLE.items():
        (folder / path).parent.mkdir(parents=True, exist_ok=True)
        (folder / path).write_text(text)
    commit_all(folder)
    first = said(spark, "search", "o/r", "validate token", "--verbose")
    assert "parsed 6 files" in capsys.readouterr().err
    assert said(spark, "search", "o/r", "validate token", "--verbose") == first and "cached" in capsys.readouterr().err
    said(spark, "overview", "o/r", "--verbose")
    assert "cached" in capsys.readouterr().err
    (folder / "src/extra.ts").write_text("export function validateTokenTwice() {}\n")
    commit_all(folder)
    assert "validateTokenTwice" in said(spark, "search", "o/r", "validate token twice", "--verbose") and "parsed 7 files" in capsys.readouterr().err
    monkeypatch.setattr(artifacts, "CACHE_LIMIT", 1)
    monkeypatch.setattr(artifacts.evict, "__defaults__", (1,))
    said(spark, "search", "o/r", "token")
    assert not folder.exists()


def test_stored_index_is_reused_while_it_fits(spark, repo, tmp_path):
    spec = artifacts.Spec("o", "r", "v1")
    one = stored_index(spark, str(repo), spec, tmp_path)
    assert search.search(one, "validate token", 1).collect()[0]["name"] == "validateToken"
    assert json.loads((artifacts.artifact_dir(spec, tmp_path) / "index.json").read_text())["format_version"] == artifacts.FORMAT_VERSION
    assert artifacts.artifact_dir(spec, tmp_path) != artifacts.artifact_dir(artifacts.Spec("o", "r"), tmp_path)
    assert stored_engine(spark, str(repo), spec, tmp_path.as_uri()).fresh  # without a commit nothing is known to fit


def test_store(spark, tmp_path):
    store = Store(spark, tmp_path / "a b")
    assert store.read("x") is None and not store.exists("x")
    store.write("x", "é")
    store.write("x", "ö")
    assert store.read("x") == "ö" and store.exists("x")
    with store.lock():
        with pytest.raises(TimeoutError):
            with store.lock(wait=0.1):
                pass
    with store.lock():
        assert store.exists(".lock")
    store.delete("x")
    assert not store.exists("x") and not store.exists(".lock")


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from siftwork.plans.lineage import shared_folder

    conf = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    with pytest.raises(ValueError):
        shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    assert shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[2]")))


def test_specs_and_guards(tmp_path, monkeypatch):
    assert artifacts.Spec.parse("o/r@v1") == artifacts.Spec("o", "r", "v1") and artifacts.Spec.parse("a.b/c-d") == artifacts.Spec("a.b", "c-d")
    for bad in ("or", "o/r/x", "../r", "o/..", "o/r@", "o/r@-x", "o /r", ""):
        with pytest.raises(ValueError):
            artifacts.Spec.parse(bad)
    for bad in ("", ".", "..", "a/b", "a\\b"):
        with pytest.raises(ValueError):
            artifacts.component(bad)
    with pytest.raises(ValueError):
        artifacts.cleanup("/tmp/elsewhere")
    monkeypatch.setenv("SIFTWORK_CACHE_DIR", str(tmp_path))
    assert artifacts.cache_root() == tmp_path
    with pytest.raises(ValueError):
        clone.clone("x", tmp_path / "c", "-evil")


def test_meta(tmp_path):
    assert artifacts.load_meta(tmp_path) is None
    meta = artifacts.save_meta(tmp_path, "abc")
    assert artifacts.load_meta(tmp_path) == meta and meta.fits("abc") and not meta.fits("abd")
    (tmp_path / "meta.json").write_text("{broken")
    assert artifacts.load_meta(tmp_path) is None


def test_eviction(spark, tmp_path):
    root = tmp_path / "siftwork"
    for n, name in enumerate("abc"):
        p = root / "repos" / "o" / name / "HEAD" / "f"
        p.parent.mkdir(parents=True)
        p.write_bytes(b"x" * 100)
        os.utime(p, (n, n))
    gone = artifacts.evict(root, 150)
    assert [g.split("/")[-2] for g in gone] == ["a", "b"]
    df = spark.createDataFrame([(1, c, 100, n) for n, c in enumerate("abc")], "k int, path string, size long, touched_at long")
    assert sorted(r["path"] for r in artifacts.evicted(df, 150, "k").collect()) == ["a", "b"]


def test_module_config(spark, tmp_path):
    def write(path, text):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)

    write("tsconfig.json", '{ // root\n "extends": "./base.json", "compilerOptions": {"baseUrl": ".", "paths": {"@shared/*": ["shared/*",],},}, }')
    write("base.json", '{"compilerOptions": {"paths": {"a//b": ["x/*y*/z"], "out": ["../../q"]}}}')
    write("packages/web/tsconfig.json", '{"extends": ["../../tsconfig.json", "@acme/config/base.json"], "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["./src/*"]}}}')
    write("packages/web/jsconfig.json", '{"compilerOptions": {"paths": {"no": ["no"]}}}')
    write("node_modules/@acme/config/base.json", '{"extends": "./base.json", "compilerOptions": {"paths": {"#/*": ["shared/*"]}}}')
    write("node_modules/tsconfig.json", '{"compilerOptions": {"paths": {"no": ["no"]}}}')
    got = {(s, p): (b, t) for s, b, p, t in module_config.rules(str(tmp_path))}
    assert got == {
        ("", "@shared/*"): ("", ["shared/*"]), ("", "a//b"): ("", ["x/*y*/z"]), ("packages/web", "@/*"): ("packages/web", ["packages/web/src/*"]), ("packages/web", "@shared/*"): ("packages/web", ["shared/*"]),
        ("packages/web", "a//b"): ("packages/web", ["x/*y*/z"]), ("packages/web", "#/*"): ("packages/web", ["node_modules/@acme/config/shared/*"]),
        ("", "*"): ("", ["*"]), ("packages/web", "*"): ("packages/web", ["packages/web/*"]),
    }
    assert module_config.module_rules(spark, str(tmp_path)).count() == 8
    assert module_config.extended("a", "./tsconfig.base") == "a/tsconfig.json"
    assert module_config.rules(str(tmp_path / "packages")) != []


def test_stream(spark, tmp_path):
    schema = "doc_id long, filepath string, section_title string, heading_hierarchy array<string>, content string, code_symbols array<string>, start_line int, end_line int"
    source = tmp_path / "in"
    row = lambda i, text: (i, f"{i}.md", "Title", [], text, [], 1, 2)
    spark.createDataFrame([row(1, "old words"), row(2, "shared words")], schema).write.parquet(str(source))
    incremental.follow(spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "out")).awaitTermination()
    spark.createDataFrame([row(1, "fresh text"), row(3, "shared text")], schema).write.mode("append").parquet(str(source))
    incremental.follow(spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "out")).awaitTermination()
    index = incremental.current(spark, str(tmp_path / "out"))
    assert index.total_docs.first()["n"] == 3
    found = {q: sorted(r["doc_id"] for r in search.search(index, q).collect()) for q in ("old", "fresh", "shared", "title")}
    assert found == {"old": [], "fresh": [1], "shared": [2, 3], "title": [1, 2, 3]}
