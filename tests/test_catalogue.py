"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import math
import re

import duckdb
import pytest

from quillon import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query_equals_sql(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    r = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(norm(row[names.index(c)]) for c in columns) for row in r.fetchall())


def test_entry_point_has_every_query():
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_corpus_operators():
    import pathlib

    import quillon

    top = pathlib.Path(quillon.__file__).parent
    for f in top.rglob("*.py"):
        if "llm" not in f.relative_to(top).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", f.read_text(), re.M)


def test_phrases_of_the_texts_are_ranked_once(spark):
    plan = catalogue.queries()["q13_phrase_status"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan  # the ranking lies in a stored table that both the counts and the status read
