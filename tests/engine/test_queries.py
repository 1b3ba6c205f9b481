import pytest

import cuadra.document_queries  # registers its queries
import cuadra.stream_queries
from cuadra.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, sf_dir, same_as_sql, name):
    assert same_as_sql(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir) > 0


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert abs(sum(r.amount for r in rows)) < 0.01 and [r.category for r in sorted(rows, key=lambda r: r.ord)][0] == "BANCO"
    assert set(e.oracle_sql()) <= set(e.queries())
