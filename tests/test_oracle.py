"""Every query with SQL gives the rows of its SQL, on the smallest tables; the others run."""

import os

import pytest

import __spark_entry__ as driver
from tallyforge.plans.base import QUERIES, SQL

from .oracle import database, difference

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_of_sql(spark, name):
    assert difference(spark, QUERIES[name], SQL[name], DATA) == ""


#: Rows of the queries without SQL, as a query over the same tables; their values are held against brute force elsewhere.
ROWS = {
    "jn12_str10_fuzzy_best": "SELECT 0", "jn12_jn11_contamination": "SELECT 0", "jn12_jn14_smp03_audited_split": "SELECT count(*) FROM documents", "lrn04_joint_training": "SELECT 2", "lrn05_local_heads": "SELECT 4",
    "sel24_lrn08_utility_gate": "SELECT count(DISTINCT user_id) FROM events", "sel26_crossfit_gate": "SELECT count(DISTINCT user_id) FROM events", "sel33_learned_ranking_pass": "SELECT count(*) FROM lineitem", "smp04_lrn01_lrn02_ranker_fit": "SELECT 8",
    "str02_latex_key": "SELECT count(*) FROM documents", "str03_compact_key": "SELECT count(*) FROM documents", "txt02_txt04_chunk_ends": "SELECT count(*) FROM documents", "txt03_txt05_token_places": "SELECT count(*) FROM documents", "txt03_txt05_token_offsets": "SELECT count(*) FROM documents",
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    rows = QUERIES[name](spark, DATA).collect()
    assert len({repr(r) for r in rows}) == len(rows)  # each answers something else
    if name in ROWS:
        n = database(DATA).execute(ROWS[name]).fetchone()[0]
        assert len(rows) >= n if ROWS[name] == "SELECT 0" else len(rows) == n


def test_driver_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() == 4
