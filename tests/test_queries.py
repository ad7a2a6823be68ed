"""Every registered query of the reference's operators against its SQL, over whole tables."""

import datetime
import math

import duckdb
import pytest

from lodestone.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v.isoformat() if isinstance(v, datetime.datetime) else v

    return sorted(map(repr, (tuple(map(cell, r)) for r in rows)))


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    if name not in catalog.ORACLES:
        assert rows
        return
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert plain(rows) == plain(want)
