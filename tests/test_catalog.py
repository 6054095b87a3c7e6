"""Every registered query against its SQL twin on the smallest tables."""

from collections import Counter
from pathlib import Path

import pytest

from rentlens.plans import load_catalog
from tests import oracle

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="benchmark tables not there")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(load_catalog()))
def test_query(spark, con, name):
    q = load_catalog()[name]
    ok, message = oracle.compare(spark, con, FOLDER, q.run, q.sql)
    assert ok, message


def test_bindings_reach_every_case(spark):
    run = lambda n: load_catalog()[n].run(spark, "/root/testdata/sf0.01")
    assert set(r.grade for r in run("risk_score").select("grade").distinct().collect()) == {"LOW", "MEDIUM", "HIGH", "CRITICAL"}
    assert set(r.price_burden for r in run("risk_score").select("price_burden").distinct().collect()) == {0, 18, 31, 40, 45}
    assert set(r.method for r in run("property_match").select("method").distinct().collect()) >= {
        "parcel", "building_name", "ambiguous_observed_name", "parcel_frequency", "unseen_address_name", "district_frequency", "type_frequency", "no_reference"}
    assert Counter(r.n_pages for r in run("right_evidence").collect()).keys() == {1, 2}
    assert set(r.snapshot_state for r in run("snapshot_reuse").collect()) == {
        "REUSED", "SNAPSHOT_MISSING", "TARGET_CHANGED", "LEDGER_KEY_INVALID", "ADDRESS_MISSING", "LEDGER_FEATURES_MISSING", "UNIT_AREA_INVALID"}
    assert set(r.match_status for r in run("watchlist_matches").collect()) == {"MATCH_HIGH", "MATCH_NAME_ONLY", "NO_MATCH"}
