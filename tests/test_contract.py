"""The driver's contract, and that the library stands without its optional part."""

import ast
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from threadloom.plans import catalog

ROOT = Path(__file__).parent.parent
D = "/root/testdata/sf0.001"


def test_nothing_imports_the_optional_part():
    for path in ROOT.joinpath("threadloom").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path


def test_sql_belongs_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert catalog.FLAGSHIP in contract.queries()


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(n for n in catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in os.listdir(D):
        con.sql(f"create view {f[:-8]} as select * from '{D}/{f}'")

    def row(values):
        return str([f"{v + 0.0:.5f}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v) for v in values])

    df = catalog.queries()[name](spark, D)
    cols = sorted(df.columns)
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == cols
    assert sorted(row(r) for r in df.select(*cols).collect()) == sorted(row(r) for r in want.project(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_streamed_summary_equals_batch(spark):
    a, b = catalog.queries()["stream_user_summary"](spark, D), catalog.queries()["user_summary"](spark, D)
    assert a.exceptAll(b.select(*a.columns)).count() == 0 and a.count() == b.count()
