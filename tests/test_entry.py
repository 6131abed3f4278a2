import pytest

import __spark_entry__ as entry



def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["allele_counts", "gwas_hwe", "bed_dual_threshold", "linearized_edges", "prs_score"])
def test_query_equals_its_statement(spark, name):
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
    import compare
    import duckdb

    con, folder = duckdb.connect(), "/root/testdata/sf0.001"
    for t in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {t.stem} AS SELECT * FROM read_parquet('{t}')")
    got, want = entry.queries()[name](spark, folder).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and compare.canonical(got) == compare.canonical(want)
