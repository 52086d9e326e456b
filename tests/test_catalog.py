"""Each query with SQL gives the SQL's rows."""

import math
from pathlib import Path

import duckdb
import pytest

from tidemark import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def plain(rows):
    def value(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 9)
        return x.isoformat() if hasattr(x, "isoformat") else x

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    found = catalog.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = plain(found.select(columns).collect())
    assert len(set(columns)) == len(columns)
    if name in catalog.ORACLE_SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        wanted = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
        assert rows == plain(wanted)
