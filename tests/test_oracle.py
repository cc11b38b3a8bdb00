"""Every registered query against its check SQL."""

import re

import pytest

import __spark_entry__ as entry
from kinweave.plans.catalogue import ORACLES, QUERIES
from tests.compare import DATA, differences

SF = "0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_check_sql(spark, name):
    df = QUERIES[name](spark, DATA.format(SF))
    assert differences(df, ORACLES[name], SF) is None


def test_every_inventory_id_is_registered():
    sizes = {"s": 12, "f": 13, "j": 13, "g": 18, "w": 9, "t": 6, "u": 7, "x": 26, "d": 16, "n": 29, "a": 36}
    have = {re.match(r"([a-z]\d\d)_", name).group(1) for name in QUERIES}
    want = {f"{k}{i:02d}" for k, n in sizes.items() for i in range(1, n + 1)}
    assert want <= have


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["pais", "matrimonios_total", "matrimonios_endogamicos", "tasa_endogamia_familiar"]
    assert df.count() > 0
