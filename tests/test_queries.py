import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def con():
    import os

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def rows(table):
    cols = sorted(table.column_names)
    return cols, sorted(map(repr, zip(*(table[c].to_pylist() for c in cols))))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    assert rows(entry.queries()[name](spark, SF).toArrow()) == rows(con.sql(entry.oracle_sql()[name]).to_arrow_table())


def test_entry(spark):
    assert entry.entry(spark).count() == 200


@pytest.mark.parametrize("name", ["citation_forms", "variant_claims"])
def test_tables_of_one_file_are_dealt_to_all_cores(spark, sf, name):
    from maskwright.queries import QUERIES

    assert "REPARTITION" in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_letters_are_dealt_to_all_cores(spark, sf, tmp_path):
    from maskwright.queries import QUERIES

    for name in ("documents", "conversations"):  # as many files as cores, so that nothing is dealt for their sake
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{sf}/supplier.parquet").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    assert "hashpartitioning(s_suppkey" in QUERIES["detect_legal"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("keys", ["(12345678::BIGINT), (123456781), (1234567812345), (87654321), (-1), (-6), (null), (7)", "(3::DOUBLE), (4), (20000000)"])
def test_letters_of_any_key(spark, con, tmp_path, keys):
    for name in ("documents", "conversations"):
        con.sql(f"copy (select * from {name} limit 20) to '{tmp_path}/{name}.parquet'")
    con.sql(f"copy (select * from (values {keys}) t(s_suppkey)) to '{tmp_path}/supplier.parquet'")
    c = duckdb.connect()
    for name in ("documents", "conversations", "supplier"):
        c.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    assert rows(entry.queries()["detect_legal"](spark, str(tmp_path)).toArrow()) == rows(c.sql(entry.oracle_sql()["detect_legal"]).to_arrow_table())
