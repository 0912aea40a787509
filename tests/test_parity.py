"""Every registered query of the reference's operators against its DuckDB oracle."""

import pytest

from parity import canon, duck
from tessera.plans.catalog import load_oracles, load_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(load_oracles()))
def test_query_equals_its_oracle(spark, con, key):
    df = load_queries()[key](spark, SF)
    cur = con.execute(load_oracles()[key])
    cols = [d[0] for d in cur.description]
    assert canon(df.columns, df.collect()) == canon(cols, cur.fetchall())
