"""Every registered query with SQL gives what the SQL gives; the extractor agrees with the stored symbols."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from siftwork.plans.queries import QUERIES, SQL


def normal(v):
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        return normal(v.item())
    return round(v, 9) if isinstance(v, float) else v


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(normal(x) for x in r) for r in df[columns].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for name in os.listdir(data):
        c.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{data}/{name}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, db, name):
    assert rows(QUERIES[name](spark, data).toPandas()) == rows(db.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_extracted_symbols_agree_with_the_stored_ones(spark, data):
    got = {(r["repo_id"], r["filepath"], r["name"], r["start_line"]): r for r in QUERIES["extracted_symbols"](spark, data).collect()}
    stored = spark.read.parquet(f"{data}/symbols.parquet").dropDuplicates(["symbol_id"]).collect()
    assert len(stored) > 100
    for s in stored:
        r = got[s["repo_id"], s["filepath"], s["name"], s["start_line"]]
        assert (r["kind"], r["end_line"], r["params"], r["export"]["publicness"], r["export"]["export_kind"]) == (s["kind"], s["end_line"], s["params"], s["export"]["publicness"], s["export"]["export_kind"])


def test_markdown_round_trip(spark, data):
    got = {(r["repo_id"], r["filepath"], r["section_title"], r["content"]) for r in QUERIES["markdown_sections"](spark, data).collect()}
    stored = spark.read.parquet(f"{data}/doc_sections.parquet").where("section_title is not null and content rlike '\\\\S' and start_line is not null").collect()
    # contents that hold headings of their own, or an open fence, are cut differently
    plain = [s for s in stored if "\r" not in s["content"] and s["content"].strip() == s["content"] and "#" not in s["content"] and s["content"].count("```") % 2 == 0]
    same = sum((s["repo_id"], s["filepath"].replace("\\", "/"), s["section_title"].strip(), s["content"]) in got for s in plain)
    assert len(plain) > 10 and same >= 0.9 * len(plain)
