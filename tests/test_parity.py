"""Every query with an oracle gives what DuckDB gives over the smallest tables."""

import glob
import os

import duckdb
import pytest

from millrace import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, tmp_path, name):
    found = plans.queries()[name](spark, SF)
    found.write.parquet(str(tmp_path / "out"))
    mine = duck.sql(f"select * from '{tmp_path}/out/*.parquet'")
    if name not in plans.oracle_sql():
        assert len(mine.columns) == len(found.columns)
        return
    theirs = duck.sql(plans.oracle_sql()[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    chosen = ", ".join(f'"{c}"' for c in columns)
    rows = [duck.sql(f"select {chosen} from {side} order by all").fetchall() for side in ("mine", "theirs")]
    assert rows[0] == rows[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
