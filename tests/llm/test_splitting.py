"""Problem 3: pieces are exact cuts with their lines, under the limit, and as natural as can be."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwork.llm import splitting as S


def check(text, limit, overlap):
    got = S.split(text, limit, overlap)
    covered = [False] * len(text)
    before = None
    for start, end, again, _ in got:
        assert 0 < end - start <= limit and 0 <= again <= overlap
        if before is not None:
            assert text[start : start + again] == text[before - again : before] and (start + again == before or again == 0)
        covered[start:end] = [True] * (end - start)
        before = end
    assert all(c or text[i].isspace() for i, c in enumerate(covered))
    return got


PARTS = st.lists(st.sampled_from(["word ", "Sentence one. ", "\n", "\n\n", "\r\n", "\r\n\r\n", "```\n", "x" * 15, "longword" * 4 + " ", "é"]), max_size=40)


@settings(max_examples=300, deadline=None)
@given(PARTS, st.integers(5, 60), st.integers(0, 20))
def test_pieces(parts, limit, overlap):
    check("".join(parts), limit, min(overlap, limit - 1))


def kind(text, limit):
    """Brute force of the definition."""
    blocks, run, fence = [], [], False
    for line in text.split("\n"):
        bare = line.rstrip("\r")
        if fence:
            run.append(line)
            if bare.lstrip().startswith("```"):
                blocks.append(run)
                run, fence = [], False
        elif bare.lstrip().startswith("```"):
            blocks.append(run)
            run, fence = [line], True
        elif bare.strip():
            run.append(line)
        else:
            blocks.append(run)
            run = []
    blocks.append(run)
    if all(len("\n".join(b).rstrip("\r\n")) <= limit for b in blocks):
        return "block"
    return "line" if all(len(line.rstrip("\r")) <= limit for line in text.split("\n")) else "inside"


@settings(max_examples=300, deadline=None)
@given(PARTS, st.integers(5, 60))
def test_kinds_against_brute_force(parts, limit):
    text = "".join(parts)
    levels = [S._LEVELS.index(p[3]) for p in S.split(text, limit, 0)]
    if levels and len(text) > limit and not re.search(r"[^\n]\r(?!\n)", text):
        assert {0: "block", 1: "line"}.get(max(levels), "inside") == kind(text, limit)


def test_cuts_are_natural():
    text = "\n\n".join(f"Paragraph {i} " + "w " * 20 for i in range(9))
    assert all(p[3] == "block" for p in check(text, 150, 0))
    assert all(text[a - 1 : a] in ("", "\n") for a, *_ in S.split(text, 150, 0))
    one = "One two three. " * 30
    assert all(one[a:b].startswith("One") for a, b, *_ in S.split(one, 100, 0))
    assert [b - a for a, b, *_ in S.split("x" * 250, 100, 0)] == [100, 100, 50]
    with pytest.raises(ValueError):
        S.split("x", 10, 10)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 90), st.integers(101, 700), st.sampled_from(["", " ", "\n", "\n\n"]))
def test_runs_without_a_space_overlap_in_full(before, run, gap):
    text = "ab " * (before // 3) + gap + "x" * run
    got = check(text, 100, 20)
    inside = [n for (a, b, n, _), last in zip(got[1:], got) if last[1] > text.index("x") + 20]
    assert inside and all(n == 20 for n in inside)
    assert all(n > 0 for _, _, n, _ in got[1:])


def test_parts_that_would_fill_a_piece_leave_room_for_the_overlap():
    words = " ".join(f"w{i:03}" for i in range(19))
    got = check("\n\n".join([words] * 4), 100, 20)
    assert all(n >= 9 for _, _, n, _ in got[1:])
    assert [p[3] for p in S.split("\n\n".join([words] * 4), 100, 0)] == ["block"] * 4


def test_blank_long_contents(spark):
    assert check(" " * 250, 100, 20) == [(0, 100, 0, "block"), (100, 200, 0, "block"), (200, 250, 0, "block")]
    df = spark.createDataFrame([(1, "\n" * 2001, 1)], "section_id long, content string, start_line int")
    assert S.pieces(df).count() == 2 and S.cut_kinds(df).collect()[0]["cut_kind"] == "block"


def test_table(spark):
    schema = "section_id long, repo_id int, content string, start_line int, end_line int, level string, pieces int"
    long = "\n\n".join("line one\nline two " + "w " * 400 for _ in range(4))
    rows = [(1, 1, long, 10, 20, "clash", 9), (1, 1, long, 10, 20, "clash", 9), (2, 1, None, 1, 1, "", 0), (3, 1, "", 1, 1, "", 0), (4, 1, "x" * 2000, 1, 1, "", 0), (5, 1, "x" * 2001, None, 1, "", 0), (6, 1, "y" * 100_000, 1, 1, "", 0)]
    df = spark.createDataFrame(rows, schema)
    got = S.pieces(df).distinct().orderBy("section_id", "piece_no").collect()
    assert {r["section_id"] for r in got} == {1, 5, 6}
    first = [r for r in got if r["section_id"] == 1]
    assert [r["piece_no"] for r in first] == list(range(1, first[0]["pieces"] + 1))
    file = ["# heading", *long.split("\n")]
    for r in first:
        assert "\n".join(file[r["start_line"] - 10 : r["end_line"] - 9]).find(r["content"]) >= 0
    assert all(r["start_line"] is None for r in got if r["section_id"] == 5)
    kinds = {r["section_id"]: r["cut_kind"] for r in S.cut_kinds(df).collect()}
    assert kinds == {1: "block", 5: "inside", 6: "inside"}
    assert S.pieces(spark.createDataFrame([], schema)).count() == 0
