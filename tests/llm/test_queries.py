import glob
import os

import duckdb
import pytest

from wattloom.llm import queries


def test_all_run_on_the_smallest_tables(spark, sf):
    found = queries.queries()
    assert {"p2_found", "p3_found", "p8_packed", "p9_found", "p10_found"} <= set(found)
    columns = {
        "p2_found": ["dup_level", "key_a", "key_b"], "p3_found": ["id", "garmin_activity_id"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
    }
    for name, f in found.items():
        df = f(spark, sf)
        assert name not in columns or df.columns == columns[name]
        assert df.count() > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf, name):
    c = duckdb.connect()
    c.sql("SET timezone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries.queries()[name](spark, sf)
    rows = c.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(rows) and rows
