"""Every registered query against its DuckDB oracle on the smallest scale factor."""
import os

import pytest

from revlens.checks.compare import compare, duckdb_conn
from revlens.checks.oracle_sql import ORACLE
from revlens.registry import QUERIES

SKIP = os.environ.get("REVLENS_SKIP_ORACLE") == "1"


@pytest.fixture(scope="module")
def con(sf_dir):
    return duckdb_conn(sf_dir)


@pytest.mark.skipif(SKIP, reason="REVLENS_SKIP_ORACLE=1")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, sf_dir, con, name):
    r = compare(spark, name, QUERIES[name], ORACLE.get(name), sf_dir, con)
    assert r["status"] in ("match", "no-oracle"), r


def test_entry_smoke(spark):
    import importlib.util
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spec = importlib.util.spec_from_file_location("entry", os.path.join(root, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    df = mod.entry(spark)
    assert df.count() > 0
    assert set(mod.oracle_sql()) <= set(mod.queries())
