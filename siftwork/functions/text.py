"""Column functions on text, identifiers and paths: built-in expressions only, but for stemming."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import MAX_FIELD_LENGTH
from .stemming import stem

# The places where an identifier breaks, and what separates words of a text.
IDENTIFIER_BREAK = r"[_\-./]|(?<=\p{IsLowercase})(?=\p{IsUppercase})|(?<=\p{IsUppercase})(?=\p{IsUppercase}\p{IsLowercase})"
WORD_BREAK = r"[^\p{IsAlphabetic}\p{N}_]"
WORD = r"[\p{IsAlphabetic}\p{N}_]+"
MAX_WORD_BYTES = 80


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _parts(c: Column | str) -> Column:
    """Parts in lower case, some of them empty: breaks are marked first, so that no part is handled by itself."""
    return F.split(F.lower(F.regexp_replace(_col(c), IDENTIFIER_BREAK, "\n")), "\n")


def split_identifier(c: Column | str) -> Column:
    """Lower-case parts: breaks at _ - . /, before an upper after a lower case letter, and before
    the last upper of an upper run that a lower case letter follows.  Null gives null."""
    return F.filter(_parts(c), lambda x: x != "")


def _long_enough(tokens: Column) -> Column:
    return F.filter(tokens, lambda x: F.octet_length(x) > 1)


def identifier_tokens(c: Column | str) -> Column:
    """Parts of more than one byte."""
    return _long_enough(_parts(c))


def text_tokens(c: Column | str) -> Column:
    """Words of 2 to 79 bytes in lower case; an underscore does not separate."""
    words = F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD), F.lit(0))
    return F.filter(words, lambda x: F.octet_length(x).between(2, MAX_WORD_BYTES - 1))


@F.arrow_udf(T.ArrayType(T.StringType()))
def stemmed(tokens: pa.Array) -> pa.Array:
    """The Porter2 stems of arrays of tokens, repeats kept; each different token of a batch is stemmed once."""
    coded = tokens.flatten().dictionary_encode()
    stems = pa.array([None if t is None else stem(t) for t in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), stems, mask=tokens.is_null() if tokens.null_count else None)


def _counted(fields: pa.Array, stemming: bool) -> pa.Array:
    """Of each row's fields (arrays of tokens) their length and different terms with counts; a null field stays null.

    What is counted is a row's own, so nothing needs to be shuffled; each different token of a batch is
    coded and stemmed once.
    """
    each = fields.flatten()
    coded = each.flatten().dictionary_encode()
    terms, codes = coded.dictionary, pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    if stemming:
        again = pa.array([stem(t) for t in terms.to_pylist()], pa.string()).dictionary_encode()
        terms, codes = again.dictionary, np.append(again.indices.to_numpy(zero_copy_only=False).astype(np.int64), -1)[codes]
    lengths = pc.fill_null(pc.list_value_length(each), 0).to_numpy(zero_copy_only=False)
    keys = (np.repeat(np.arange(len(each)), lengths) * max(len(terms), 1) + codes)[codes >= 0]
    keys, tf = np.unique(keys, return_counts=True)
    of, code = np.divmod(keys, max(len(terms), 1))
    pairs = pa.StructArray.from_arrays([terms.take(pa.array(code)), pa.array(tf.astype(np.int32))], ["term", "tf"])
    starts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(each)))]).astype(np.int32)
    counts = pa.StructArray.from_arrays([pa.array(np.minimum(lengths, MAX_FIELD_LENGTH).astype(np.int32)), pa.ListArray.from_arrays(pa.array(starts), pairs)], ["dl", "terms"], mask=each.is_null())
    rows = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(fields), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(rows), counts)


_TERMS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())]))
_COUNTS = T.ArrayType(T.StructType([T.StructField("dl", T.IntegerType()), T.StructField("terms", _TERMS)]))


@F.arrow_udf(_COUNTS)
def term_counts(fields: pa.Array) -> pa.Array:
    return _counted(fields, False)


@F.arrow_udf(_COUNTS)
def stem_counts(fields: pa.Array) -> pa.Array:
    return _counted(fields, True)


def invalid_query_letters(c: Column | str) -> Column:
    """Up to five different alphabetic characters outside ASCII, in order; empty if the query is valid."""
    return F.slice(F.array_distinct(F.regexp_extract_all(_col(c), F.lit(r"[\p{IsAlphabetic}&&[^\x00-\x7F]]"), F.lit(0))), 1, 5)


def validate_query(query: str) -> None:
    """Raises ValueError for a query with letters outside ASCII; digits, marks and emoji pass."""
    bad = list(dict.fromkeys(c for c in query if c.isalpha() and not c.isascii()))
    if bad:
        raise ValueError("only ASCII letters can be searched; found " + ", ".join(bad[:5]))


# -- paths ---------------------------------------------------------------------------


def surface_path(path: Column | str) -> Column:
    return F.translate(_col(path), "\\", "/")


def in_dir(path: Column | str, folder: str) -> Column:
    """Whether the path lies below the folder (a file named like it does not)."""
    return surface_path(path).startswith(folder + "/")


def extension(path: Column | str) -> Column:
    """The final extension in lower case, else ''; a leading dot begins a name, not an extension."""
    return F.lower(F.regexp_extract(surface_path(path), r"[^/]\.([^./]+)$", 1))


def is_example_path(path: Column | str) -> Column:
    return F.lower(_col(path)).rlike("example|sample|demo")


def is_test_candidate(name: Column | str, path: Column | str) -> Column:
    """Whether a symbol may be a test: by marks anywhere in the path, or a name that begins with test."""
    marked = F.lower(surface_path(path)).rlike(r"/tests/|/test/|/__tests__/|/spec/|\.test\.|_test\.|\.spec\.|_spec\.")
    return F.coalesce(marked, F.lit(False)) | F.coalesce(_col(name).startswith("test"), F.lit(False))


def file_stem(path: Column | str) -> Column:
    """The file name before its first dot, without every _test and _spec."""
    first = F.substring_index(F.substring_index(surface_path(path), "/", -1), ".", 1)
    return F.replace(F.replace(first, F.lit("_test"), F.lit("")), F.lit("_spec"), F.lit(""))


def parent_dir(path: Column | str) -> Column:
    return F.regexp_extract(surface_path(path), r"^(.*)/", 1)


def surface_ref(kind: str | Column, path: Column | str, name: Column | str, line: Column | str) -> Column:
    """kind:path#name@Lline"""
    k = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(k, F.lit(":"), surface_path(path), F.lit("#"), _col(name), F.lit("@L"), _col(line).cast("string"))


def resolve_relative(base: Column, path: Column) -> Column:
    """The path seen from a folder: . and .. resolved (a .. at the top is lost); an absolute path replaces the folder."""
    joined = F.when(path.startswith("/"), path).otherwise(F.concat(base, F.lit("/"), path))
    parts = F.filter(F.split(joined, "/"), lambda x: (x != "") & (x != "."))
    empty = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        return F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))

    return F.array_join(F.aggregate(parts, empty, step), "/")


def match_alias(pattern: Column, specifier: Column) -> Column:
    """What the one * of a pattern stands for, '' for an equal pattern without *, else null."""
    star = F.instr(pattern, "*")
    before = F.substring_index(pattern, "*", 1)
    after = F.substr(pattern, star + 1)
    fits = specifier.startswith(before) & specifier.endswith(after) & (F.length(specifier) >= F.length(before) + F.length(after))
    middle = F.substr(specifier, F.length(before) + 1, F.length(specifier) - F.length(before) - F.length(after))
    return F.when(star == 0, F.when(pattern == specifier, F.lit(""))).when(fits, middle)


def substitute_alias(target: Column, captured: Column) -> Column:
    """The target with its first * replaced."""
    star = F.instr(target, "*")
    return F.when(star == 0, target).otherwise(F.concat(F.substr(target, F.lit(1), star - 1), captured, F.substr(target, star + 1)))


# Fixed value: the endings that a specifier without one is tried with.
MODULE_ENDINGS = ("ts", "tsx", "js", "jsx", "mts", "cts", "mjs", "cjs")


def module_candidates(path: Column) -> Column:
    """The files that a module path may stand for, in lexicographic order."""
    ends = [F.concat(path, F.lit(f".{e}")) for e in MODULE_ENDINGS] + [F.concat(path, F.lit(f"/index.{e}")) for e in MODULE_ENDINGS]
    return F.when(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1) != "", F.array(path)).otherwise(F.array_sort(F.array(*ends)))


def in_scope(path: Column, scope: Column) -> Column:
    return (scope == "") | (path == scope) | path.startswith(F.concat(scope, F.lit("/")))


def signature(kind: Column, name: Column, params: Column) -> Column:
    return F.when(kind.isin("Function", "Method"), F.concat(name, F.lit("("), F.array_join(params, ", "), F.lit(")"))).otherwise(name)


# -- comments --------------------------------------------------------------------------


def comment_flags(text: Column) -> Column:
    low = F.lower(text)
    marks = {"Deprecated": low.contains("deprecated"), "Experimental": low.contains("experimental"), "Internal": low.contains("@internal") | low.contains("internal use only"), "Unsafe": low.contains("unsafe")}
    return F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in marks.items())))


def comment_info(text: Column, source: Column) -> Column:
    """The comment struct of a text without markers; null for a blank one."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    sentence = F.regexp_extract(plain, r"^[^.!?]*[.!?]", 0)
    summary = F.when(sentence != "", sentence).otherwise(F.left(plain, F.lit(120)))
    preview = F.left(plain, F.lit(200))
    made = F.struct(
        summary.alias("summary_line"), F.when(preview != summary, preview).alias("body_preview"), comment_flags(plain).alias("flags"), source.alias("source"), F.lit("SummaryOnly").alias("normalization_status")
    )
    return F.when(plain != "", made)


def searchable_comment(comment: Column) -> Column:
    """Summary and preview; the preview repeats the summary, whose words so count twice."""
    s, p = comment["summary_line"], comment["body_preview"]
    return F.when(comment.isNotNull(), F.when(p.isNull() | (p == s), s).otherwise(F.concat_ws(" ", s, p)))


# -- filter arguments --------------------------------------------------------------------


def normal_dirs(dirs: list[str]) -> list[str]:
    """Folder filters: split at commas, trimmed, / for \\, without ./ in front and / around; blanks dropped."""
    out = []
    for d in (x for given in dirs for x in given.split(",")):
        d = d.strip().replace("\\", "/")
        while d.startswith("./"):
            d = d[2:]
        if d := d.strip("/"):
            out.append(d)
    return out


def normal_extensions(exts: list[str]) -> list[str]:
    """Extension filters: split at commas, trimmed, without leading dots, ASCII letters in lower case; blanks dropped."""
    cleaned = (re.sub("[A-Z]+", lambda m: m[0].lower(), x.strip().lstrip(".")) for given in exts for x in given.split(","))
    return [x for x in cleaned if x]
