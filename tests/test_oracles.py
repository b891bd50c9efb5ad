"""Every registered query with check SQL gives the same rows at the smallest scale."""
import compare
import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    names, rows = compare.spark_rows(QUERIES[name](spark, SF))
    assert rows
    if name in ORACLES:
        expected_names, expected = compare.sql_rows(con, ORACLES[name])
        assert names == expected_names
        assert rows == expected, compare.first_difference(rows, expected)


@pytest.mark.parametrize("name", ["k3_capsule_sections", "k3_capsule_summary", "k3_capsule_layers"])
def test_capsules_keep_long_documents(spark, tmp_path, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 200")
    long = F.concat(F.lit("# Long\n"), F.repeat(F.lit("line of a long text\n"), 30_000))
    docs.withColumn("text", F.when(F.col("doc_id") % 20 == 3, long).otherwise(F.col("text"))).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    names, rows = compare.spark_rows(QUERIES[name](spark, str(tmp_path)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected_names, expected = compare.sql_rows(con, ORACLES[name])
    assert names == expected_names and rows == expected, compare.first_difference(rows, expected)
