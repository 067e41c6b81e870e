"""Every query of the training-data problems over the smallest tables, if they are there, beside SQL or what it promises."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from millrace.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables")
COLUMNS = {
    "p3_found": ["id_a", "id_b"], "p3_neighbours": ["id", "other", "rank", "similarity"], "p4_found": ["doc_id", "language"], "p4_segments": ["doc_id", "segment", "language", "confidence", "sentences", "text"],
    "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "kind", "found"], "p8_redacted": ["doc_id", "text", "n_replaced"],
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    frame = queries.QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in frame.collect()]
    if name in COLUMNS:
        assert frame.columns == COLUMNS[name]
    if name.endswith("_found"):
        assert rows and len(set(rows)) == len(rows)
    if name in queries.ORACLES:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW rag_chunks AS SELECT * FROM '{FOLDER}/rag_chunks.parquet'")
        assert Counter(con.execute(queries.ORACLES[name]).fetchall()) == Counter(rows)
