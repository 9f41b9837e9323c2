import __spark_entry__ as E
import pytest


def test_entry_has_rows(spark):
    assert E.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["p1_found", "ref_R1_hotspots", "ref_G3_downstream", "ref_R4_extract_keywords"])
def test_some_queries_against_sql(spark, name):
    from pathlib import Path

    import duckdb

    from tools.compare import compare

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    d = "/root/testdata/sf0.001"
    for p in Path(d).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    assert ": ok" in compare(spark, con, name, d)
