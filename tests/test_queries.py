"""Every query of the core beside its SQL over the smallest tables, if they are there."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from compare import cell
from millrace.plans import function_queries, problem_queries, table_queries

FOLDER = "/root/testdata/sf0.001"
MODULES = (problem_queries, table_queries, function_queries)
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize(("module", "name"), [(m, name) for m in MODULES for name in m.QUERIES])
def test_query(spark, tables, module, name):
    frame = module.QUERIES[name](spark, FOLDER)
    rows = [tuple(map(cell, r)) for r in frame.select(*sorted(frame.columns)).collect()]
    if name not in module.ORACLES:
        return
    result = tables.execute(module.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    expected = Counter(tuple(cell(r[i]) for i in order) for r in result.fetchall())
    # What is left are values that rounding took to different sides.
    more, less = (sorted((a - b).elements(), key=str) for a, b in ((Counter(rows), expected), (expected, Counter(rows))))
    assert len(more) == len(less)
    for a, b in zip(more, less, strict=True):
        assert all(x == pytest.approx(y, abs=2e-4, rel=1e-6) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b, strict=True)), (a, b)
