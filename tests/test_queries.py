"""Every query of the library proper runs, and agrees with its SQL."""

import pytest
from conftest import TESTDATA

from dossier.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, oracle, same):
    got = catalogue.QUERIES[name](spark, f"{TESTDATA}/sf0.001").toPandas()
    if name in catalogue.ORACLES:
        same(got, oracle(catalogue.ORACLES[name]))
    else:
        assert len(got.columns)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
