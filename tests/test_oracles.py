"""A cross-section of registered queries against their SQL; ``tests.compare`` runs all."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"
NAMES = ["b1_detect_vendor", "n6_webhook", "v1_validate", "w7_ingest", "r1_register_class", "x2_resolve", "x7_delta",
         "f35_type_names", "t4_spec_ecs", "n10_ecs_legacy", "f4_iso_ms_legacy"]


@pytest.mark.parametrize("name", NAMES)
def test_equal(spark, name):
    assert difference(spark, connect(SF), entry.queries()[name], entry.oracle_sql()[name], SF) is None
