"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from rillgraph import catalog, catalog_io  # noqa: F401  (its queries join the catalog's)

SF = "/root/testdata/sf0.001"
#: Queries whose rows are too few at the smallest scale; the windows of some don't fill there.
LARGER = {"temporal_triangles", "triangle_count", "vertex_constraints", "exact_features_500", "self_similarity_500", "one_group_500", "match_lines", "vertex_constant", "stream_paths", "feature_lookup", "eh_features_500", "language_members", "language_vertex_info", "language_subgraph", "two_edge_path"}


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    return {sf: duckdb.connect() for sf in (SF, SF.replace("0.001", "0.01"))}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    sf = SF.replace("0.001", "0.01") if name in LARGER else SF
    con = duck[sf]
    con.execute(f"create or replace view events as select * from '{sf}/events.parquet'")
    got = catalog.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    mine = sorted(str([plain(r[c]) for c in cols]) for r in got.collect())
    cur = con.execute(catalog.ORACLES[name])
    names = [x[0] for x in cur.description]
    theirs = sorted(str([plain(dict(zip(names, r, strict=True))[c]) for c in cols]) for r in cur.fetchall())
    assert sorted(names) == cols and mine == theirs and mine
    if name == "triangle_count":
        assert got.first()[0] > 100


def test_hash_functions_of_halves(spark, duck, tmp_path):
    """Times at half a tenth of a second, and next to it: the SQL's cast takes a half to the even neighbour."""
    con = duck[SF]
    con.execute(f"copy (select 10 * i + j as event_id, make_timestamp(1704067200000000 + i * 3700000 * 41 + i * 100000 + 50000 + j - 1) as ts, i as user_id, 'view' as event_type, 1.0 as value, '{{\"k\": 1}}' as props from range(2000) a(i), range(3) b(j)) to '{tmp_path}/events.parquet' (format parquet)")
    con.execute(f"create or replace view events as select * from '{tmp_path}/events.parquet'")
    got = sorted(map(tuple, catalog.QUERIES["hash_functions"](spark, str(tmp_path)).select("edge_id", "octet", "deci").collect()))
    assert got == sorted(con.execute(f"select edge_id, octet, deci from ({catalog.ORACLES['hash_functions']})").fetchall())


def test_vast_files_sorts_in_as_many_ranges_as_partitions(spark, monkeypatch):
    """The ranges that are sorted before they are written follow the session's partitions, not a fixed number."""
    import pyspark.sql.classic.dataframe as frames

    asked = []
    real = frames.DataFrame.repartitionByRange
    monkeypatch.setattr(frames.DataFrame, "repartitionByRange", lambda self, *args: asked.append(args) or real(self, *args))
    assert catalog.QUERIES["vast_files"](spark, SF).count() == 1000
    assert asked == [("edge_id",)]


def test_entry_needs_no_subpackage(spark, tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parents[1]
    shutil.copytree(root / "rillgraph", tmp_path / "rillgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=tmp_path, check=True, timeout=120)
