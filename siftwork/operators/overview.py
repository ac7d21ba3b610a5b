"""The public surface of repositories: APIs, types, linked tests, hints and coverage.

Everything works on many repositories at once.  Key columns (repo_id) go through all joins;
what is ranked within a repository is cut to the wanted number before the shuffle, and no
window holds a repository as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..plans.lineage import written
from ..schemas import LINK_REASONS, TYPE_KINDS

#: Link reasons in their fixed order.
PATH, NAME, STEM, DIRECTORY = LINK_REASONS

# The sentences of the coverage notes, and the reasons of hints.
NOTES = {
    "publicness": "some symbol publicness values remain unknown",
    "comments": "some surfaced symbols have no normalized comment summary",
    "tests": "linked tests were found for only part of the public API surface",
    "fallback": "overview fell back to symbols with unknown publicness",
    "truncated": "overview output truncated by render budget",
}
HINT_REASONS = {"api": "top public API", "type": "top public type", "test": "top linked test"}


@dataclass(frozen=True)
class Budget:
    apis: int = 6
    types: int = 6
    tests: int = 6
    hints: int = 4
    comment_chars: int = 140


def _publicness() -> Column:
    return F.col("export.publicness")


def surface_public() -> Column:
    return F.coalesce(_publicness().isin("Public", "Reexported"), F.lit(False))


def surface_kind() -> Column:
    """api for functions, type for types, else null."""
    return F.when(F.col("kind") == "Function", "api").when(F.col("kind").isin(*TYPE_KINDS), "type")


def public_apis(symbols: DataFrame) -> DataFrame:
    return symbols.where((F.col("kind") == "Function") & surface_public())


def public_types(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("kind").isin(*TYPE_KINDS) & surface_public())


def score(base: Column, comment: Column, path: Column, linked: Column) -> Column:
    """Base, +0.3 for a summary, +0.2 for flags, +1.5 for a linked test, -0.7 below /examples/."""
    return (
        base
        + F.when(comment["summary_line"].isNotNull(), 0.3).otherwise(0.0)
        + F.when(F.coalesce(F.size(comment["flags"]), F.lit(0)) > 0, 0.2).otherwise(0.0)
        + F.when(linked, 1.5).otherwise(0.0)
        - F.when(X.surface_path(path).contains("/examples/"), 0.7).otherwise(0.0)
    )


def first_of(df: DataFrame, k: int, by: list[str], *order) -> DataFrame:
    """The first k rows of each group, with their rank; each task passes on k rows of a group at most."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


# -- tests -------------------------------------------------------------------------------


def _name_words(stemming: bool) -> Column:
    words = X.identifier_tokens("name")
    return F.array_sort(F.array_distinct(X.stemmed(words) if stemming else words))


def test_links(symbols: DataFrame, candidates: DataFrame, id_column: str, *keys: str, k: int = 3, stemming: bool = True) -> DataFrame:
    """(keys, id, rank, test_id, test_path, test_ref, test_name, reasons, score): the best k tests linked to each symbol.

    Rules: all (stemmed) words of the name occur in the path of the test; they are all words of
    its name; equal file stems; equal folders.  A name without words passes the first two.  More
    rules come first, then path and reference of the test.  A symbol that is a candidate itself
    may be its own test.

    Symbols that agree in words, stem and folder have the same tests, which are looked for once.
    A test among the best k is among the first k that pass what it passes of the stem and folder
    rules, by the rules on words, path and reference; so only the first k tests of each such group
    are joined.  Names are matched by equi-joins: a name by its rarest word, looked up among the
    words of test names and, over runs of three letters, among test paths.
    """
    ks, words = list(keys), _name_words(stemming)
    left = written(symbols.select(*ks, F.col(id_column).alias("id"), words.alias("words"), X.file_stem("filepath").alias("stem"), X.parent_dir("filepath").alias("dir")), "linked")
    right = candidates.select(
        *ks, F.col(id_column).alias("test_id"), words.alias("test_words"), X.file_stem("filepath").alias("test_stem"), X.parent_dir("filepath").alias("test_dir"), F.col("name").alias("test_name"),
        X.surface_path("filepath").alias("test_path"), F.lower(X.surface_path("filepath")).alias("low"), X.surface_ref("test", "filepath", "name", "start_line").alias("test_ref"),
    )
    right = written(right, "tests")
    profile = [*ks, "words", "stem", "dir"]
    profiles = left.select(*profile).distinct()
    lists = profiles.where(F.size("words") > 0).select(*ks, "words").distinct()
    asked = lists.select(*ks, F.explode("words").alias("word")).distinct()

    # test paths that contain a word, by the first three letters of the word
    paths = right.select(*ks, "low").distinct()

    def runs(n: int):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("low") - (n - 1), F.lit(1))), lambda i: F.substr("low", i, F.lit(n)))

    grams = paths.select(*ks, "low", F.explode(F.array_distinct(F.concat(runs(1), runs(2), runs(3)))).alias("gram"))
    in_path = asked.withColumn("gram", F.left("word", F.lit(3))).join(grams, [*ks, "gram"]).where(F.contains(F.col("low"), F.col("word"))).select(*ks, "word", "low").distinct()
    in_name = right.select(*ks, "test_words").distinct().select(*ks, "test_words", F.explode("test_words").alias("word")).join(asked, [*ks, "word"], "left_semi")

    def rarest(found: DataFrame) -> DataFrame:
        """The word of each list that is found least often; lists with a word that is not found drop out."""
        often = found.groupBy(*ks, "word").agg(F.count("*").alias("n"))
        each = lists.select(*ks, "words", F.explode("words").alias("word")).join(often, [*ks, "word"])
        whole = each.groupBy(*ks, "words").agg(F.min(F.struct("n", "word")).alias("w"), F.count("*").alias("c")).where(F.col("c") == F.size("words"))
        return whole.select(*ks, "words", F.col("w.word").alias("word"))

    fits_path = rarest(in_path).join(in_path, [*ks, "word"]).where(F.forall("words", lambda t: F.contains(F.col("low"), t))).select(*ks, "words", "low")
    fits_name = rarest(in_name).join(in_name, [*ks, "word"]).where(F.size(F.array_except("words", "test_words")) == 0).select(*ks, "words", "test_words")
    about = [*ks, "test_id", "test_stem", "test_dir", "test_path", "test_ref"]
    hits = fits_path.join(right, [*ks, "low"]).select("words", *about, F.lit(1).alias("p"), F.lit(0).alias("n"))
    hits = hits.unionByName(fits_name.join(right, [*ks, "test_words"]).select("words", *about, F.lit(0).alias("p"), F.lit(1).alias("n")))
    hits = hits.groupBy("words", *about).agg((F.max("p") + F.max("n")).alias("m"))
    order = ["test_path", "test_ref", "test_id"]

    def joined(tests: DataFrame, on: dict[str, str], some: DataFrame = profiles) -> DataFrame:
        """Profiles with the first tests of the group that each belongs to."""
        if "test_dir" in on:
            tests = tests.where("test_dir <> ''")
        by = [F.desc("m"), *order] if "m" in tests.columns else order
        few = first_of(tests, k, [*ks, *on], *by).select("test_id", *ks, *(F.col(a).alias(b) for a, b in on.items()))
        return some.join(few, [*ks, *on.values()]).select(*profile, "test_id")

    same = [{}, {"test_stem": "stem"}, {"test_dir": "dir"}, {"test_stem": "stem", "test_dir": "dir"}]
    parts = [joined(hits, {"words": "words"} | s) for s in same] + [joined(right, s) for s in same[1:]] + [joined(right, {}, profiles.where(F.size("words") == 0))]
    pairs = parts[0]
    for more in parts[1:]:
        pairs = pairs.unionByName(more)
    both = pairs.distinct().join(right, [*ks, "test_id"])
    rules = (
        F.when(F.forall("words", lambda t: F.contains(F.col("low"), t)), PATH),
        F.when(F.size(F.array_except("words", "test_words")) == 0, NAME),
        F.when(F.col("stem") == F.col("test_stem"), STEM),
        F.when((F.col("dir") != "") & (F.col("dir") == F.col("test_dir")), DIRECTORY),
    )
    scored = both.withColumn("reasons", F.array_compact(F.array(*rules))).withColumn("score", F.size("reasons") + F.lit(0.5))
    best = first_of(scored, k, profile, F.desc("score"), *order)
    return left.join(best, profile).select(*ks, "id", "rank", "test_id", "test_path", "test_ref", "test_name", "reasons", "score")


# -- re-exports ---------------------------------------------------------------------------


def is_namespace() -> Column:
    return (F.col("local_name") == "*") & (F.col("exported_name") != "*")


def resolved_reexports(reexports: DataFrame, symbols: DataFrame, reexport_id: str, symbol_id: str, *keys: str, rules: DataFrame | None = None) -> DataFrame:
    """(keys, reexport id, symbol id, exported name): the symbol each named re-export stands for.

    A specifier that begins with a dot is resolved against the file's folder, others by all alias
    rules in whose scope the file lies (a base folder is the rule *); each is tried with the module
    endings, all in lexicographic order.  The first candidate file with a symbol of that name (or its
    default export, for `default`) wins, then the first symbol.  One hop only.  Wildcards take every
    public symbol of the target that is not a default export.  Null specifiers mean the own file.
    """
    k = list(keys)
    base = reexports.select(*k, F.col(reexport_id).alias("rid"), "filepath", "local_name", "exported_name", "source_specifier")
    folder = X.parent_dir("filepath")
    relative = F.col("source_specifier").startswith(".")
    target = F.when(relative, X.resolve_relative(folder, F.col("source_specifier")))
    own = base.where("source_specifier is null").select(*k, "rid", X.surface_path("filepath").alias("path"))
    paths = base.withColumn("module", target).where("module is not null").select(*k, "rid", "module")
    if rules is not None:
        alias = base.where(~relative).join(F.broadcast(rules), X.in_scope(X.surface_path("filepath"), F.col("scope_dir")))
        got = alias.withColumn("captured", X.match_alias(F.col("pattern"), F.col("source_specifier"))).where("captured is not null")
        paths = paths.unionByName(got.select(*k, "rid", F.explode("targets").alias("t"), "captured").select(*k, "rid", X.substitute_alias(F.col("t"), F.col("captured")).alias("module")))
    tried = paths.select(*k, "rid", F.explode(X.module_candidates(F.col("module"))).alias("path")).unionByName(own).distinct()
    wanted = tried.join(base.select(*k, "rid", "local_name", "exported_name"), [*k, "rid"])
    there = symbols.select(*k, F.col(symbol_id).alias("sid"), X.surface_path("filepath").alias("path"), "name", "ordinal", "export")
    both = wanted.join(there, [*k, "path"])
    named = both.where((F.col("name") == F.col("local_name")) | ((F.col("local_name") == "default") & (F.col("export.export_kind") == "Default")))
    single = first_of(named.where("local_name <> '*'"), 1, [*k, "rid"], "path", "ordinal", "sid").select(*k, "rid", "sid", "exported_name")
    wild = both.where((F.col("local_name") == "*") & (F.col("exported_name") == "*") & surface_public() & F.coalesce(F.col("export.export_kind") != "Default", F.lit(True)))
    return single.unionByName(wild.select(*k, "rid", "sid", F.col("name").alias("exported_name")))


# -- the report ----------------------------------------------------------------------------


def surface(symbols: DataFrame, reexports: DataFrame, id_column: str, reexport_id: str, *keys: str, rules: DataFrame | None = None) -> DataFrame:
    """(keys, surface, id, name, filepath, start_line, signature, publicness, extra, fallback, kind, comment): what is on the surface.

    Public functions and types, those that a re-export stands for (at the place of the
    re-export), and namespace re-exports; where a key has none of these, symbols of unknown
    publicness stand in.
    """
    k = list(keys)
    kinds = symbols.withColumn("surface", surface_kind()).where("surface is not null")

    def direct(df: DataFrame, fallback: bool) -> DataFrame:
        return df.select(
            *k, "surface", F.col(id_column).alias("id"), "name", X.surface_path("filepath").alias("filepath"), "start_line", F.coalesce("signature_preview", "name").alias("signature"),
            _publicness().alias("publicness"), F.lit(0.0).alias("extra"), F.lit(fallback).alias("fallback"), "kind", "comment",
        )

    hops = resolved_reexports(reexports, symbols, reexport_id, id_column, *k, rules=rules)
    places = reexports.select(*k, F.col(reexport_id).alias("rid"), X.surface_path("filepath").alias("filepath"), "start_line")
    targets = kinds.select(*k, F.col(id_column).alias("sid"), "surface", "kind", "params", "comment")
    again = hops.join(places, [*k, "rid"]).join(targets, [*k, "sid"])
    params = F.coalesce("params", F.array().cast("array<string>"))
    again = again.select(
        *k, "surface", F.col("sid").alias("id"), F.col("exported_name").alias("name"), "filepath", "start_line", X.signature(F.col("kind"), F.col("exported_name"), params).alias("signature"),
        F.lit("Reexported").alias("publicness"), F.lit(0.1).alias("extra"), F.lit(False).alias("fallback"), "kind", "comment",
    )
    types = dict(symbols.dtypes)
    source = F.concat(F.lit("namespace re-export from "), F.col("source_specifier"))
    said = F.when(source.isNotNull(), F.struct(*((source if f.name == "summary_line" else F.lit(None).cast(f.dataType)).alias(f.name) for f in symbols.schema["comment"].dataType.fields)))
    spaces = reexports.where(is_namespace()).select(
        *k, F.lit("type").alias("surface"), F.lit(None).cast(types[id_column]).alias("id"), F.col("exported_name").alias("name"), X.surface_path("filepath").alias("filepath"), "start_line", F.col("exported_name").alias("signature"),
        F.lit("Reexported").alias("publicness"), F.lit(0.1).alias("extra"), F.lit(False).alias("fallback"), F.lit("Module").alias("kind"),
        said.alias("comment"),
    )
    public = direct(kinds.where(surface_public()), False).unionByName(again).unionByName(spaces)
    unknown = direct(kinds.where(_publicness() == "Unknown"), True).join(public.select(*k).distinct(), k, "left_anti")
    return public.unionByName(unknown)


@dataclass(frozen=True)
class Overview:
    """The parts of the report, for each key: cards and tests have a rank within their list."""

    links: DataFrame  # the best tests of each API symbol
    cards: DataFrame  # every card, with its tests
    shown: DataFrame  # the first cards of each list
    tests: DataFrame  # the first tests
    hints: DataFrame
    meta: DataFrame  # coverage, notes, truncated


def cards(symbols: DataFrame, reexports: DataFrame, id_column: str, reexport_id: str, *keys: str, budget: Budget = Budget(), rules: DataFrame | None = None, stemming: bool = True) -> tuple[DataFrame, DataFrame]:
    """(all cards, links).  A card has its ref, flags, score and the best tests of its symbol (APIs only)."""
    k = list(keys)
    base = written(surface(symbols, reexports, id_column, reexport_id, *k, rules=rules), "surface")
    wanted = base.where("surface = 'api'").select(*k, F.col("id").alias(id_column)).distinct()
    candidates = symbols.where(X.is_test_candidate("name", "filepath"))
    links = written(test_links(symbols.join(wanted, [*k, id_column], "left_semi"), candidates, id_column, *k, stemming=stemming), "links")
    # three links at most
    tests = links.groupBy(*k, "id").agg(F.array_sort(F.collect_list(F.struct("rank", "test_ref", "test_path", "test_name", "reasons", "score"))).alias("tests")).withColumn("surface", F.lit("api"))
    made = base.join(tests, [*k, "surface", "id"], "left").withColumn("linked", F.greatest(F.size(F.coalesce("tests", F.array().cast(tests.schema["tests"].dataType))), F.lit(0)))
    start = F.when(F.col("surface") == "api", 3.0).otherwise(2.0)
    comment, spaces = F.col("comment"), F.col("id").isNull()
    points = F.when(spaces, F.lit(2.1)).otherwise(score(start, comment, F.col("filepath"), F.col("linked") > 0) + F.col("extra"))
    return made.select(
        *k, "surface", "id", "kind", "name", "filepath", "start_line", "signature", "publicness", F.when(spaces, F.col("comment.summary_line")).otherwise(F.left(F.col("comment.summary_line"), F.lit(budget.comment_chars))).alias("summary"),
        F.coalesce(F.col("comment.flags"), F.array().cast("array<string>")).alias("flags"), "tests", "linked", F.round(points, 4).alias("score"), X.surface_ref(F.col("surface"), "filepath", "name", "start_line").alias("ref"), "fallback",
    ), links


def test_totals(every: DataFrame, *keys: str) -> DataFrame:
    """Per test of some API card: its path and name, how many cards it is linked to, and the best score."""
    one = every.select(*keys, "ref", F.explode("tests").alias("t"))
    return one.groupBy(*keys, F.col("t.test_ref").alias("test_ref")).agg(F.min("t.test_path").alias("test_path"), F.min("t.test_name").alias("test_name"), F.max("t.score").alias("score"), F.count_distinct("ref").alias("symbols"))


def test_cards(every: DataFrame, cap: int, *keys: str) -> DataFrame:
    """The first tests of each key, with the cards they are linked to and the reasons, in the order of the cards.

    Lists are gathered for these few tests only.
    """
    k = list(keys)
    few = first_of(test_totals(every, *k), cap, k, F.desc("score"), "test_path", "test_ref")
    one = every.select(*k, F.struct((-F.col("score")).alias("s"), "filepath", "ref").alias("place"), F.explode("tests").alias("t")).select(*k, "place", F.col("t.test_ref").alias("test_ref"), F.col("t.reasons").alias("reasons"))
    order = F.array_sort(F.collect_list(F.struct("place", "reasons")))
    lists = one.join(few.select(*k, "test_ref"), [*k, "test_ref"], "left_semi").groupBy(*k, "test_ref").agg(
        F.array_distinct(F.transform(order, lambda x: x["place"]["ref"])).alias("linked_symbols"), F.array_distinct(F.flatten(F.transform(order, lambda x: x["reasons"]))).alias("reasons")
    )
    return few.join(lists, [*k, "test_ref"])


def hints(shown: DataFrame, tests: DataFrame, *keys: str, cap: int = 4) -> DataFrame:
    """Where to go on: the two best APIs, the best type and the best test of each key, as far as the cap goes."""
    pick = shown.where(((F.col("surface") == "api") & (F.col("rank") <= 2)) | ((F.col("surface") == "type") & (F.col("rank") <= 1)))
    place = F.when(F.col("surface") == "api", F.col("rank")).otherwise(F.lit(3))
    why = F.when(F.col("surface") == "api", HINT_REASONS["api"]).otherwise(HINT_REASONS["type"])
    inspect = pick.select(*keys, place.alias("place"), F.lit("InspectSymbol").alias("action"), F.col("ref").alias("target"), F.col("signature").alias("label"), why.alias("reason"))
    read = tests.where("rank = 1").select(*keys, F.lit(4).alias("place"), F.lit("ReadPath").alias("action"), F.col("test_path").alias("target"), F.col("test_name").alias("label"), F.lit(HINT_REASONS["test"]).alias("reason"))
    return first_of(inspect.unionByName(read), cap, list(keys), "place")


def meta(symbols: DataFrame, every: DataFrame, shown: DataFrame, budget: Budget, *keys: str) -> DataFrame:
    """Per key: publicness, comments and tests as Complete, Partial or Unsupported, notes, and truncated.

    Publicness and comments are those of all functions and types, tests those of the shown APIs.
    """
    k = list(keys)
    found = symbols.where(surface_kind().isNotNull()).groupBy(*k).agg(F.bool_or(F.coalesce(_publicness() == "Unknown", F.lit(False))).alias("unknown"), F.bool_and(F.col("comment").isNotNull()).alias("said"))
    linked = shown.where("surface = 'api'").groupBy(*k).agg(F.bool_and(F.col("linked") > 0).alias("all_linked"), F.bool_or(F.col("linked") > 0).alias("some_linked"))
    sizes = every.groupBy(*k).agg(F.count_if(F.col("surface") == "api").alias("apis"), F.count_if(F.col("surface") == "type").alias("types"), F.bool_or("fallback").alias("fallback"))
    n_tests = test_totals(every, *k).groupBy(*k).agg(F.count("*").alias("n_tests"))
    keyed = symbols.select(*k).unionByName(every.select(*k)).distinct()
    one = keyed
    for more in (found, linked, sizes, n_tests):
        one = one.join(more, k, "left")
    zero = F.lit(0)
    places = F.least(F.coalesce("apis", zero), F.lit(min(2, budget.apis))) + F.least(F.coalesce("types", zero), F.lit(min(1, budget.types))) + F.least(F.coalesce("n_tests", zero), F.lit(min(1, budget.tests)))
    over = (F.coalesce("apis", zero) > budget.apis) | (F.coalesce("types", zero) > budget.types) | (F.coalesce("n_tests", zero) > budget.tests) | (places > budget.hints)
    publicness = F.when(F.col("unknown").isNull(), "Unsupported").when(F.col("unknown"), "Partial").otherwise("Complete")
    comments = F.when(F.col("said").isNull(), "Unsupported").when(F.col("said"), "Complete").otherwise("Partial")
    linkage = F.when(F.col("all_linked"), "Complete").when(F.col("some_linked"), "Partial").otherwise("Unsupported")
    one = one.withColumns({"publicness": publicness, "comments": comments, "test_linkage": linkage, "truncated": over})
    marks = {"publicness": F.col("publicness") == "Partial", "comments": F.col("comments") == "Partial", "tests": F.col("test_linkage") == "Partial", "fallback": F.col("fallback"), "truncated": F.col("truncated")}
    notes = F.array_compact(F.array(*(F.when(marks[n], F.lit(text)) for n, text in NOTES.items())))
    return one.select(*k, "publicness", "comments", F.col("test_linkage").alias("tests"), notes.alias("notes"), "truncated")


def overview(symbols: DataFrame, reexports: DataFrame, id_column: str, reexport_id: str, *keys: str, budget: Budget = Budget(), rules: DataFrame | None = None, stemming: bool = True) -> Overview:
    """The whole report of every key.  Null keys are keys of their own in no join and so have no report."""
    k = list(keys)
    if not k:
        raise ValueError("an overview needs a key, such as repo_id")
    every, links = cards(symbols, reexports, id_column, reexport_id, *k, budget=budget, rules=rules, stemming=stemming)
    every = written(every, "cards")
    shown = first_of(every, max(budget.apis, budget.types), [*k, "surface"], F.desc("score"), "filepath", "ref", "id")
    shown = shown.where(F.col("rank") <= F.when(F.col("surface") == "api", budget.apis).otherwise(budget.types))
    tests = test_cards(every, budget.tests, *k)
    hint_rows = hints(shown, tests, *k, cap=budget.hints)
    return Overview(links, every, shown, tests, hint_rows, meta(symbols, every, shown, budget, *k))
