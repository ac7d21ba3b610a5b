"""Problem 1: functions and methods paired with their documentation.

Functions come from the generalised LL parser, which goes on after syntax errors and so
finds the sound functions of broken files as well.  Documentation is the comment that
ends on the line before the declaration (its decorators or attributes included) or the
docstring.  It is dropped where it says nothing that the declaration does not: empty,
rules and banners, notes to do, tool directives, licence lines, commented-out code, bare
tags, words of the name again; and where the same few words stand above so many
differently named functions that they are a template (counted by hash over the whole
collection; copies of a file or repeated rows do not make one).

Defined results: rows without content or of an unsupported extension give nothing; a
repeated row gives its functions once; an empty table gives no rows; further columns
are ignored; a function that is declared twice on one line comes out once.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stemming import stem
from ..parsing import languages
from ..parsing.symbols import functions, has_documentation
from ..plans.lineage import written
from .parse_failures import language

#: A text of at most so many words over at least this share of all documented functions, each text
#: and name counted once, is a template.
TEMPLATE_WORDS, TEMPLATE_SHARE = 5, 0.002

# Words that say no more than that there is a function, or that its documentation is wanting.
_EMPTY_WORDS = frozenset(
    """a an the this that it its is are be of for to in on with and or by from
    function functions method methods func fn def procedure routine class struct constructor ctor callback
    helper helpers utility utilities util wrapper getter setter accessor main internal private public section impl implementation
    todo tbd fixme xxx hack none null nil na n see above below documentation documented docs doc document description describe pending
    add write here missing placeholder stub auto generated autogenerated comment comments summary text fill lorem ipsum params returns return""".split()
)
_DIRECTIVE = re.compile(r"(?:@ts-\w+|eslint\b|eslint-|prettier-|noqa\b|pylint:|flake8:|mypy:|type:\s*ignore|rubocop:|nolint\b|go:|\+build|clang-format|NOLINT|istanbul|c8 ignore|tslint:|jshint|jslint|biome-|noinspection|@?suppress|SPDX-|vim?:|-\*-|coding[:=]|pragma\b|region\b|endregion\b|#?\s*(?:end)?region)", re.I)
_LEGAL = re.compile(r"(?:copyright\b|\(c\)|©|licen[sc]ed?\b|all rights reserved|released under|created (?:by|on)\b|author\b|modified (?:by|on)\b|generated by\b|upstream:)", re.I)
_TODO = re.compile(r"(?:todo|tbd|fixme|xxx|hack)\b", re.I)
_CODE = re.compile(r"\s*(?:if|for|while|switch|return|elif|else|try|catch)\b.*[:({]\s*$|[\w.\[\]\"']+\s*(?:[-+*/|&]?=|:=)\s*\S|[\w.:]+\([^)]*\)\s*;?$|(?:def|fn|func|function|class|import|let|const|var|use)\s+\w+.*[;:{(=]")
_TAG = re.compile(r"(?:[@\\](\w+)|:(param|returns?|type|rtype|raises)\b)\s*(.*)$")
#: The parts of words: camel and snake case are cut, numbers left out.
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zß-öø-ÿ]+|[^\W\d_]+")


_QUOTES = re.compile(r"[rRuUbB]{0,2}(\"\"\"|'''|\"|')")
_RUBY_BLOCK = re.compile(r"^=begin\b|^=end\b.*$", re.M)
_LEAD = re.compile(r"/\*+!?|//+[/!]?|\*+(?!/)|#+(?!\[)")
_LAST = re.compile(r"\*+/$")
_RULED = re.compile(r"^[-=~*#_+.<>/\\|:!]{2,}|[-=~*#_+<>/\\|]{2,}$")
_LETTER = re.compile(r"\w")
_SENTENCE = re.compile(r"(?<=[.!?])\s")


def clean(doc: str) -> list[str]:
    """The lines of a comment or docstring without markers and decoration; blank ones dropped."""
    text = doc.strip()
    if m := _QUOTES.match(text):
        text = text[m.end() :].removesuffix(m[1])
    out = []
    for line in (_RUBY_BLOCK.sub("", text) if "=" in text else text).split("\n"):
        line = line.strip()
        if m := _LEAD.match(line):
            line = line[m.end() :].strip()
        if not line:
            continue
        if not line[0].isalnum() or line[-1] in "-=~*#_+<>/\\|":
            line = _RULED.sub("", _LAST.sub("", _LAST.sub("", line).strip()).strip()).strip()
            if not line or not _LETTER.search(line):
                continue
        out.append(line)
    return out


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _stems(words) -> set[str]:
    return {stem(w) for w in words}


def informative(lines: list[str], name: str, signature: str) -> bool:
    """Whether some line says more than the declaration."""
    declared = known = None
    begun: set[str] = set()
    for line in lines:
        if line[-1] in ";{}" or _DIRECTIVE.match(line) or _LEGAL.match(line) or _TODO.match(line) or _CODE.match(line):
            continue
        if m := _TAG.match(line):
            if (m[1] or "").lower() in ("since", "author", "version", "copyright", "license", "date", "created", "file", "name", "function", "method", "private", "public", "internal", "api", "see"):
                continue
            line = m[3]
        words = _words(line)
        if declared is None:
            declared = {*_words(name), *_words(signature)}
            begun = {w[:3] for w in declared}
        # words with one stem begin alike, so most need no stemming
        new = [w for w in words if w not in _EMPTY_WORDS and w[:3] not in begun]
        if not new:
            known = known or _stems(declared)
            new = [w for w in words if w not in _EMPTY_WORDS and stem(w) not in known]
        if new and (len(words) > 1 or len(new[0]) > 3):
            return True
    return False


def _extract(batches):
    names = ["file_id", "language", "parses", "name", "kind", "start_line", "end_line", "signature", "doc_style", "documentation", "summary", "tells"]
    for b in batches:
        out = [[] for _ in names]
        for fid, lang, text in zip(*(b.column(c).to_pylist() for c in ("file_id", "language", "content"))):
            p = languages.read(text, lang, has_documentation)
            for f in functions(p, documented=True) if p else ():
                lines = clean(f.doc)
                if not lines:
                    continue
                row = (fid, languages.FAMILIES.get(lang, lang), p.ok, f.name, f.kind, f.start_line, f.end_line, f.signature, f.doc_style, "\n".join(lines), _SENTENCE.split(" ".join(lines), maxsplit=1)[0], informative(lines, f.name, f.signature))
                for col, v in zip(out, row):
                    col.append(v)
        types = [pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)


def documented(files: DataFrame) -> DataFrame:
    """Every function with a non-blank comment or docstring, once; tells marks what is not trivial by itself."""
    source = files.select(F.col("file_id").cast("long").alias("file_id"), language().alias("language"), "content").where("language is not null and content is not null")
    schema = "file_id bigint, language string, parses boolean, name string, kind string, start_line int, end_line int, signature string, doc_style string, documentation string, summary string, tells boolean"
    return source.mapInArrow(_extract, schema)


def pairs(files: DataFrame, template_words: int = TEMPLATE_WORDS, template_share: float = TEMPLATE_SHARE) -> DataFrame:
    """Code-description pairs: documented() without trivial and template documentation.

    The functions are written once; the names below each text are counted by hash, once each,
    with partial sums before the shuffle.  At most 1 / template_share texts can reach the share, so the
    list of templates is broadcast whatever the size of the collection.
    """
    plain = F.regexp_replace(F.lower("documentation"), r"[^\p{L}]+", " ")
    rows = written(documented(files).withColumn("text_hash", F.xxhash64(F.trim(plain))).withColumn("words", F.size(F.split(F.trim(plain), " "))), "functions")
    names = rows.select("text_hash", "words", F.xxhash64("name").alias("name")).distinct()
    least = max(3.0, names.count() * template_share)
    often = names.where(F.col("words") <= template_words).groupBy("text_hash").agg(F.count("*").alias("n"))
    templates = often.where(F.col("n") >= least).select("text_hash")
    kept = rows.where("tells").join(F.broadcast(templates), "text_hash", "left_anti")
    return kept.drop("text_hash", "words", "tells").dropDuplicates(["file_id", "name", "start_line"])
