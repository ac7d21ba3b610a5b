"""From files to an index and an overview, and stored corpora and indexes that are reused while they fit."""

from __future__ import annotations

import json
import time
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import extract, markdown, overview
from ..operators import index as I
from ..operators import search as S
from ..schemas import MODULE_RULES
from ..sources import artifacts, files
from ..sources.module_config import module_rules
from ..sources.store import Store
from .lineage import written
from .session import ship

_PARTS = ("symbols", "reexports", "sections", "rules", "statuses")


class Engine:
    """The tables of one snapshot: symbols, re-exports, sections, alias rules, what became of each
    file, and the index over them."""

    def __init__(self, spark: SparkSession, symbols: DataFrame, reexports: DataFrame, sections: DataFrame, rules: DataFrame, statuses: DataFrame):
        self.spark, self.symbols, self.reexports, self.sections, self.rules, self.statuses = spark, symbols, reexports, sections, rules, statuses
        self.fresh = True  # whether the snapshot was parsed for this engine
        self._index: I.Index | None = None

    @classmethod
    def of(cls, spark: SparkSession, table: DataFrame, rules: DataFrame | None = None) -> "Engine":
        """From a table (filepath, content) of one snapshot."""
        ship(spark)
        every = table.withColumn("repo_id", F.lit(0))
        code = every.where(~F.lower(F.substring_index("filepath", ".", -1)).isin(*extract.MARKDOWN))
        text = every.where(F.substring_index("filepath", ".", -1).isin(*extract.MARKDOWN))
        parsed = written(extract.parsed(code, "repo_id"), "parsed")
        done = parsed.where("status = 'Ok'")
        one = done.select("repo_id", "filepath", F.posexplode("symbols").alias("ordinal", "s"))
        export = F.struct("s.publicness", "s.export_kind", "s.container")
        symbols = one.select(
            "repo_id", "s.name", "s.kind", "filepath", "s.start_line", "s.end_line", "s.params", X.signature(F.col("s.kind"), F.col("s.name"), F.col("s.params")).alias("signature_preview"),
            X.comment_info(F.col("s.comment"), F.col("s.comment_source")).alias("comment"), export.alias("export"), "ordinal",
        )
        reexports = done.select("repo_id", "filepath", F.posexplode("reexports").alias("ordinal", "r")).select("repo_id", "filepath", "r.*", "ordinal")
        # Markdown always parses
        sizes = text.select("repo_id", "filepath", F.when(F.col("content").isNull(), "Oversized").otherwise("Ok").alias("status"))
        statuses = parsed.select("repo_id", "filepath", "status").unionByName(sizes)
        rules = spark.createDataFrame([], MODULE_RULES) if rules is None else rules
        return cls(spark, symbols, reexports, markdown.sections(text.where("content is not null"), "repo_id"), rules, statuses)

    @classmethod
    def from_dir(cls, spark: SparkSession, root: str) -> "Engine":
        return cls.of(spark, files.scan(spark, root), module_rules(spark, root))

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: list[tuple[str, str]]) -> "Engine":
        return cls.of(spark, files.from_rows(spark, rows))

    def add(self, rows: list[tuple[str, str]]) -> "Engine":
        """An engine over these files as well; a file of the same path takes the place of the old one."""
        more = Engine.from_rows(self.spark, rows)
        new = more.statuses.select("filepath").distinct()

        def both(old: DataFrame, added: DataFrame) -> DataFrame:
            return old.join(new, "filepath", "left_anti").select(added.columns).unionByName(added)

        parts = (both(getattr(self, n), getattr(more, n)) for n in ("symbols", "reexports", "sections"))
        return Engine(self.spark, *parts, self.rules, both(self.statuses, more.statuses))

    @property
    def doc_count(self) -> int:
        """The number of documents in the index."""
        return self.index.constants[0]

    def save(self, folder: str) -> None:
        for n in _PARTS:
            getattr(self, n).write.mode("overwrite").parquet(f"{folder}/{n}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> "Engine":
        ship(spark)
        made = cls(spark, *(spark.read.parquet(f"{folder}/{n}") for n in _PARTS))
        made.fresh = False
        return made

    @property
    def index(self) -> I.Index:
        """Documents are numbered by path, type and place in the file, so every build gives the same numbers."""
        if self._index is None:
            code = self.symbols.select("filepath", F.lit("Code").alias("type"), "ordinal", F.struct("name", "kind", "start_line", "end_line", "params", "comment").alias("code"), F.lit(None).alias("doc"))
            made = F.struct("section_title", "heading_hierarchy", "content", "code_symbols", "start_line", "end_line")
            docs = self.sections.select("filepath", F.lit("Doc").alias("type"), "ordinal", made.alias("doc"))
            both = I.numbered(code.drop("doc").unionByName(docs, allowMissingColumns=True), "filepath", "type", "ordinal")
            every = I.code_documents(both.where("type = 'Code'").select("doc_id", "filepath", "code.*")).unionByName(I.doc_documents(both.where("type = 'Doc'").select("doc_id", "filepath", "doc.*")))
            self._index = I.build(every)
        return self._index

    def search(self, query: str, k: int = 10, filters: S.Filters = S.Filters()) -> DataFrame:
        return S.search(self.index, query, k, filters)

    def report(self) -> DataFrame:
        """One row: files parsed, and the paths of those that were not."""
        return extract.report(self.statuses, "repo_id").drop("repo_id")

    def overview(self, budget: overview.Budget = overview.Budget()) -> overview.Overview:
        s = I.numbered(self.symbols, "filepath", "ordinal", name="symbol_id")
        r = I.numbered(self.reexports, "filepath", "ordinal", name="reexport_id")
        return overview.overview(s, r, "symbol_id", "reexport_id", "repo_id", budget=budget, rules=self.rules)


def _fits(store: Store, name: str, commit: str | None) -> bool:
    """Whether an artifact is there, whole (its description is written last), and of this commit and format."""
    try:
        meta = artifacts.Meta(**json.loads(store.read(f"{name}.json") or ""))
    except (ValueError, TypeError):
        return False
    return commit is not None and meta.fits(commit) and store.exists(f"{name}-{commit}")


def _describe(store: Store, name: str, commit: str | None) -> None:
    store.write(f"{name}.json", json.dumps(asdict(artifacts.Meta(commit or "none", int(time.time())))))


def stored_engine(spark: SparkSession, root: str, spec: artifacts.Spec, cache: str | Path | None = None, with_index: bool = True) -> Engine:
    """The engine of a snapshot from its stored corpus (and index), each made anew and stored where it
    does not fit.  The cache may be any URI that the cluster reaches."""
    store = Store(spark, artifacts.artifact_uri(spec, cache))
    commit = artifacts.head_commit(root)
    corpus, index = f"corpus-{commit or 'none'}", f"index-{commit or 'none'}"
    with store.lock():
        if _fits(store, "corpus", commit):
            engine = Engine.load(spark, store.uri(corpus))
        else:
            store.delete("index.json")
            Engine.from_dir(spark, root).save(store.uri(corpus))
            _describe(store, "corpus", commit)
            engine = Engine.load(spark, store.uri(corpus))
            engine.fresh = True
        if with_index:
            if not _fits(store, "index", commit):
                engine.index.save(store.uri(index))
                _describe(store, "index", commit)
            engine._index = I.Index.load(spark, store.uri(index))
    return engine


def stored_index(spark: SparkSession, root: str, spec: artifacts.Spec, cache: str | Path | None = None) -> I.Index:
    return stored_engine(spark, root, spec, cache).index
