import importlib
import os
import sys

import pytest

DATA = "/root/testdata/sf0.001"


def entry_module():
    return importlib.import_module("__spark_entry__")


def test_every_sql_has_a_query():
    e = entry_module()
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry(spark):
    assert entry_module().entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_core_queries_equal_sql(spark):
    import glob
    import json
    import math

    import duckdb

    from sparseloom.plans import catalogue

    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f'CREATE VIEW "{os.path.basename(p)[:-8]}" AS SELECT * FROM \'{p}\'')

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 5) + 0.0
        return [plain(x) for x in v] if isinstance(v, list) else v

    for name in sorted(catalogue.SQL):
        ours, theirs = catalogue.QUERIES[name](spark, DATA).toArrow(), c.execute(catalogue.SQL[name]).to_arrow_table()
        cols = sorted(ours.column_names)
        assert cols == sorted(theirs.column_names), name
        table = lambda t: sorted(json.dumps([plain(x) for x in r.values()], default=str) for r in t.select(cols).to_pylist())  # noqa: B023, E731
        assert table(ours) == table(theirs), name


def test_core_does_not_need_the_llm_package():
    for path, _, files in os.walk(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "sparseloom")):
        if os.path.basename(path) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(path, f), encoding="utf-8") as source:
                    assert "llm" not in source.read(), f
    assert sys.modules
