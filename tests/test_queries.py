"""Every registered query beside its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import DATA, connect, differences
from prepforge.queries import ORACLES, QUERIES

SF_DIR = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, SF_DIR)
    sql = ORACLES.get(name)
    if sql is None:
        assert frame.count() > 0
    else:
        assert differences(frame, con, sql) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_matches_known_values(spark):
    rows = {r["split"]: r for r in entry.entry(spark).collect()}
    assert rows["train"]["n"] == 4809 and rows["val"]["n"] == 1191
    assert rows["train"]["mae"] == pytest.approx(4521.8092, abs=1e-4)
    assert rows["val"]["mse"] == pytest.approx(112657541.9, abs=0.1)
    assert rows["val"]["r2"] == pytest.approx(0.862501, abs=1e-6)
