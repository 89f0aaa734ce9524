"""Every registered query of the media index against DuckDB, over the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from tessella import index_queries  # noqa: F401  (registers)
from tessella import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        return float(f"{float(x):.10g}")
    return str(x).replace("+00:00", "")


def rows(table, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in table.to_pylist()), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, duck, name):
    found = core.queries()[name](spark, SF).toArrow()
    if name not in core.oracle_sql():
        assert found.num_rows
        return
    expected = duck.sql(core.oracle_sql()[name]).to_arrow_table()
    columns = sorted(found.column_names)
    assert columns == sorted(expected.column_names)
    assert rows(found, columns) == rows(expected, columns)


def test_ann_recall(spark):
    got = {n: {(r["clip_id"], r["seg_ord"], r["fingerprint_id"]) for r in core.queries()[n](spark, SF).collect()} for n in ("knn_exact_topk", "knn_ivf", "knn_lsh")}
    exact = got["knn_exact_topk"]
    assert len(exact & got["knn_ivf"]) / len(exact) >= 0.9
    assert len(exact & got["knn_lsh"]) / len(exact) >= 0.9


def test_streams_agree_with_batches(spark):
    for stream, batch in (("stream_live_chunks", "live_chunks"),):
        a, b = (core.queries()[n](spark, SF).toArrow() for n in (stream, batch))
        columns = sorted(a.column_names)
        assert rows(a, columns) == rows(b, columns)
