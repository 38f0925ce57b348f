import glob
import os

import duckdb
import pytest

from linkloom.plans import catalog

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return "null"
    return f"{v:.8g}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_against_sql(spark, name):
    got = [r.asDict() for r in catalog.queries()[name](spark, DATA).collect()]
    if name not in catalog.oracle_sql():
        return
    db = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cursor = db.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    wanted = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    order = sorted(columns)
    assert sorted(tuple(plain(r[c]) for c in order) for r in got) == sorted(tuple(plain(r[c]) for c in order) for r in wanted)
    assert not got or sorted(got[0]) == order


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
