"""Problem 3: cutting oversized sections at natural boundaries.

A recursive hierarchy of separators: blocks (runs of non-blank lines, and fenced code
with its fences), then lines, sentences, words, characters.  A part that fits is kept
whole; one that does not is cut at the next finer level.  Parts are packed greedily up to
the limit, and a piece begins with up to overlap characters from the end of the one
before, cut back to the start of a line or word where there is one.  Runs without a space are
cut so that a piece has room for the whole overlap, and so are parts that would fill one.

A map over the rows that are too long: nothing is shuffled.  Defined results: null, empty and
short contents need no cut and have no row; null start_line gives null lines; repeated rows are
cut once; further columns are ignored; a content over the limit
of nothing but white space is cut at characters and counts as block.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2000, 200
_LEVELS = ("block", "line", "sentence", "word", "character")
_SENTENCE = re.compile(r"(?<=[.!?;:])[\"')\]]*\s+")
_SPACE = re.compile(r"\s+")


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of the blocks; the end leaves out the last line break."""
    out: list[tuple[int, int]] = []
    pos, start, end, solid, fence = 0, -1, -1, -1, False
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        bare = line.rstrip("\r\n")
        stop = pos + len(bare)
        mark = bare.lstrip().startswith("```")
        if bare.strip():
            solid = stop
        if fence:
            end = stop
            if mark:
                out.append((start, end))
                start, fence = -1, False
        elif mark:
            if start >= 0:
                out.append((start, end))
            start, end, fence = pos, stop, True
        elif bare.strip():
            if start < 0:
                start = pos
            end = stop
        elif start >= 0:
            out.append((start, end))
            start = -1
        pos += len(line)
    if start >= 0:  # an open fence ends with its last line that is not blank
        out.append((start, solid if fence else end))
    return out


def _lines(text: str, a: int, b: int) -> list[tuple[int, int]]:
    out, pos = [], a
    while pos < b:
        e = text.find("\n", pos, b)
        e = b if e < 0 else e
        stop = e - (e > pos and text[e - 1] == "\r")
        if stop > pos:
            out.append((pos, stop))
        pos = e + 1
    return out


def _between(text: str, a: int, b: int, gap: re.Pattern) -> list[tuple[int, int]]:
    out, pos = [], a
    for m in gap.finditer(text, a, b):
        if m.start() > pos:
            out.append((pos, m.start()))
        pos = m.end()
    if pos < b:
        out.append((pos, b))
    return out


def _parts(text: str, a: int, b: int, level: int, limit: int) -> list[tuple[int, int, int]]:
    """(start, end, level at which it was cut out): parts that fit into the limit, or hold no space."""
    cut = (None, _lines, lambda t, x, y: _between(t, x, y, _SENTENCE), lambda t, x, y: _between(t, x, y, _SPACE), lambda t, x, y: [(x, y)])
    out = []
    for s, e in blocks(text) if level == 0 else cut[level](text, a, b):
        if e - s <= limit or level == 4:
            out.append((s, e, level))
        else:
            out.extend(_parts(text, s, e, level + 1, limit))
    return out


def _carry(text: str, low: int, high: int) -> int:
    """Where the overlap of a piece that ended at high begins: at a line, else a word, else anywhere from low on."""
    if low <= 0:
        return 0
    at = text.find("\n", low - 1, high)
    if 0 <= at < high - 1:
        return at + 1
    m = _SPACE.search(text, low - 1, high)
    return m.end() if m and m.end() < high else low


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(start, end, characters repeated from the piece before, level); every piece is text[start:end]."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    pieces: list[tuple[int, int, int, int]] = []
    start = end = fresh = -1
    level = again = 0
    todo = _parts(text, 0, len(text), 0, limit)[::-1]
    while todo:
        s, e, lv = todo.pop()
        if end >= 0 and e - start <= limit:
            end, level = e, max(level, lv)
            continue
        # what the part may hold where it begins a piece: the overlap comes first, unless more than that is blank
        lead = s - end + overlap if end >= 0 and overlap and s - end <= overlap else 0
        room = limit - lead if lead < limit else limit
        if e - s > room:
            if lv < 4:
                todo.extend(_parts(text, s, e, lv + 1, room)[::-1])
                s, e, lv = todo.pop()
            if e - s > room:
                todo.append((s + room, e, lv))
                e = s + room
        if end >= 0:
            pieces.append((start, end, again, level))
            keep = min(overlap, limit - (e - s) - (s - end))
            start = s if keep <= 0 else _carry(text, max(end - keep, fresh), end)
            again = max(0, end - start)
        else:
            start = s
        fresh, end, level = s, e, lv
    if end >= 0:
        pieces.append((start, end, again, level))
    elif len(text) > limit:  # nothing but white space
        pieces = [(i, min(i + limit, len(text)), 0, 0) for i in range(0, len(text), limit)]
    return [(a, b, n, _LEVELS[lv]) for a, b, n, lv in pieces]


def _cut(limit: int, overlap: int):
    names = ["section_id", "piece_no", "pieces", "content", "start_line", "end_line", "overlap", "level"]

    def run(batches):
        for b in batches:
            out = [[] for _ in names]
            for sid, text, first in zip(*(b.column(c).to_pylist() for c in ("section_id", "content", "start_line"))):
                got = split(text, limit, overlap)
                for no, (a, e, again, level) in enumerate(got, 1):
                    up = None if first is None else first + 1 + text.count("\n", 0, a)
                    down = None if first is None else first + 1 + text.count("\n", 0, e)
                    for col, v in zip(out, (sid, no, len(got), text[a:e], up, down, again, level)):
                        col.append(v)
            types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    return run


def pieces(sections: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of the sections over the limit: section_id, piece_no (from 1), pieces, content,
    start_line, end_line (lines of the file), overlap (characters repeated) and level (how
    deep the hierarchy had to go for it)."""
    long = sections.select(F.col("section_id").cast("long").alias("section_id"), "content", F.col("start_line").cast("int").alias("start_line")).where(F.char_length("content") > limit)
    schema = "section_id bigint, piece_no int, pieces int, content string, start_line int, end_line int, overlap int, level string"
    return long.mapInArrow(_cut(limit, overlap), schema)


def cut_kinds(sections: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(section_id, cut_kind): the deepest level that a section needed to fit into the limit, whatever
    the overlap: block, line or inside."""
    depth = F.max(F.array_position(F.array(*map(F.lit, _LEVELS)), F.col("level")))
    by = pieces(sections, limit, 0).groupBy("section_id").agg(depth.alias("depth"))
    kind = F.when(F.col("depth") <= 1, "block").when(F.col("depth") == 2, "line").otherwise("inside")
    return by.select("section_id", kind.alias("cut_kind"))
