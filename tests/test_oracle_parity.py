"""Every registered query with an oracle matches the DuckDB SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
from oracle_check import check, duck

from conftest import SMALL

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_key_matches_oracle(spark, con, key):
    info = check(spark, con, SMALL, key, entry.queries()[key], ORACLE[key])
    assert "error" not in info, info


def test_every_oracle_key_is_registered():
    assert set(ORACLE) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["band", "mails", "avg_risk", "mails_with_urls", "max_risk"]
    assert df.count() >= 1
