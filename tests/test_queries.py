"""Every query with an oracle against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from gradus.plans.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(value, inside=False):
    """Doubles of a column to 6 digits; inside arrays they must be equal."""
    if isinstance(value, float):
        return None if value != value else value if inside else round(value, 6)
    return tuple(plain(v, True) for v in value) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, oracle = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(oracle.columns)
    at = [oracle.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in oracle.fetchall()), key=str)
    assert sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=str) == want
