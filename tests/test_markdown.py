"""Markdown sectioning against a plain line reader."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from siftwork.operators import markdown


def plain(text):
    """Brute force: (title, hierarchy, content, symbols, start, end)."""
    lines = re.split(r"\r?\n", re.sub(r"\r?\n\Z", "", text))
    out, stack, code = [], [], False
    cur = {"title": None, "body": [], "symbols": [], "first": 1}
    block = []

    def close(last):
        body = "\n".join(cur["body"]).strip(" \n\t\r")
        if body.strip() or cur["title"] is not None and cur["symbols"]:
            out.append((cur["title"] or "Introduction", [t for _, t in stack], body, cur["symbols"], cur["first"], last))

    for n, line in enumerate(lines, 1):
        if line.lstrip(" ").startswith("```"):
            if code:
                cur["symbols"] = cur["symbols"] + sorted({w for w in re.split(r"[^\w]|(?<=\d)(?!.)", "\n".join(block)) if len(w.encode()) > 1 and re.match(r"[^\W\d]", w)})
            code, block = not code, []
            cur["body"].append(line)
            continue
        m = None if code else re.match(r"\s*(#{1,6}) (.*)$", line)
        if m and m[2].strip(" "):
            close(n - 1)
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            stack.append((len(m[1]), m[2].strip(" ")))
            cur = {"title": m[2].strip(" "), "body": [], "symbols": [], "first": n}
        else:
            if code:
                block.append(line)
            cur["body"].append(line)
    close(len(lines))
    return out


def cut(spark, *texts):
    df = markdown.sections(spark.createDataFrame([(1, f"{i}.md", t) for i, t in enumerate(texts)], "repo_id int, filepath string, content string"), "repo_id")
    rows = df.orderBy("filepath", "ordinal").collect()
    return [[(r["section_title"], r["heading_hierarchy"], r["content"], r["code_symbols"], r["start_line"], r["end_line"]) for r in rows if r["filepath"] == f"{i}.md"] for i in range(len(texts))]


README = "# Tool\n\nIntro text.\n\n## Install\n\n```sh\nnpm install tool\n```\n\n## Use\n\n### API\n\nCall `run`.\n\n```ts\nconst x = run(tool);\nrun(x)\n```\n\n# Licence\nMIT\n"


def test_readme(spark):
    got = cut(spark, README)[0]
    assert got == plain(README)
    assert [g[0] for g in got] == ["Tool", "Install", "API", "Licence"]
    assert got[2][1] == ["Tool", "Use", "API"] and got[2][3] == ["const", "run", "tool"]


def test_edges(spark):
    texts = ["", "  \n", "# Only\n## Heads\n", "text\n# A\n", "# A\r\nb\r\n", "```\n# no\n", "# A\n~~~\n# B\nx\n", "#no\n####### no\n# \nx", "# A\n```\nab\n```\n```\nab cd\n```\n"]
    got = cut(spark, *texts)
    assert got[0] == [] and got[1] == []
    assert got[2] == [("Introduction", [], "# Only\n## Heads", ["Heads", "Only"], 1, 2)]
    for text, sections in list(zip(texts, got))[3:]:
        assert sections == plain(text), text
    assert cut(spark, None) == [[]]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["# A", "## B", "### C", "text", "", "```", "ab = cd_1", "#x", " ## D ", "# "]), max_size=14), min_size=1, max_size=12))
def test_against_brute_force(spark, files):
    texts = ["\n".join(f) for f in files]
    for text, sections in zip(texts, cut(spark, *texts)):
        want = plain(text)
        if want or not text.strip():
            assert sections == want, text


def test_stored_sections_without_a_title_keep_their_text(spark, tmp_path):
    from siftwork.plans.queries import markdown_sections

    schema = "section_id long, repo_id int, filepath string, ordinal int, section_title string, heading_hierarchy array<string>, content string, start_line int"
    rows = [(1, 1, "a.md", 0, None, [], "Before.", None), (2, 1, "a.md", 1, "One", ["One"], "Text.", 3), (3, 1, "a.md", 2, None, None, "More.", 9), (4, 1, "a.md", 3, "Two", ["One", "Two"], "End.", None), (5, 1, "a.md", 4, None, None, None, 12)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/doc_sections.parquet")
    got = markdown_sections(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(r["section_title"], r["content"], r["start_line"]) for r in got] == [("Introduction", "Before.", 1), ("One", "Text.\nMore.", 2), ("Two", "End.", 5)]
