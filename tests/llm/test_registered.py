"""What is registered, and the one query that SQL can express against its SQL."""

import os
from collections import Counter

import pytest

SF_DIR = "/root/testdata/sf0.001"


def test_registered():
    import __spark_entry__ as contract

    names = list(contract.queries())
    assert all(sum(name.startswith(f"op{n}_") for name in names) == 1 for n in range(1, 14))
    assert "pipeline" in names


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables not there")
def test_url_verdicts_match_their_sql(spark):
    import duckdb

    import __spark_entry__ as contract

    base = duckdb.connect()
    base.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF_DIR}/pages.parquet'")
    answer = base.execute(contract.oracle_sql()["op7_bloom_cascade"])
    names = [d[0] for d in answer.description]
    got = contract.queries()["op7_bloom_cascade"](spark, SF_DIR)
    assert sorted(got.columns) == sorted(names)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(answer.fetchall())
