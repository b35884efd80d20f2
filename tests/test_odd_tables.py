"""Queries against their SQL on small tables with what the given ones don't hold."""

import duckdb

from tallyforge.plans.registry import QUERIES, SQL

from .oracle import difference


def test_exact_subsets_leaves_out_large_questions(spark, tmp_path):
    columns = "k AS l_orderkey, i AS l_linenumber, i AS l_partkey, i AS l_suppkey, (i * 7 % 19)::DOUBLE AS l_extendedprice, 1.0::DOUBLE AS l_quantity, 0.0::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax, DATE '2020-01-01' AS l_shipdate, 'A' AS l_returnflag, CASE WHEN i % 3 = 0 THEN 'O' ELSE 'F' END AS l_linestatus"
    duckdb.sql(f"COPY (SELECT {columns} FROM (SELECT unnest([1, 2, 3, 4, 5]) AS k, unnest([3, 4, 16, 17, 18]) AS n), range(1, 20) t(i) WHERE i <= n) TO '{tmp_path}/lineitem.parquet'")
    name = "bud05_exact_subsets"
    assert sorted(x.question_uid for x in QUERIES[name](spark, str(tmp_path)).collect()) == [2, 3]  # of 4 and 16 candidates
    assert difference(spark, QUERIES[name], SQL[name], str(tmp_path)) == ""


def test_ragged_slice_keeps_the_sign_of_zero(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT i AS vec_id, [-1e-9, 1e-9, -2.5e-7, 2.5, -7.0, -0.25, 0.0, -4e-7]::FLOAT[] AS embedding FROM range(8) t(i)) TO '{tmp_path}/embeddings.parquet'")
    name = "src11_ragged_slice"
    assert difference(spark, QUERIES[name], SQL[name], str(tmp_path)) == ""
