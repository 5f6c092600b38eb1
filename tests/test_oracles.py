"""Every query with SQL gives the same rows as that SQL on the smallest data."""

from __future__ import annotations

import pytest
from conftest import DATA, rows_of

from tintero.plans import catalog

FOLDER = "sf0.01"
pytestmark = pytest.mark.skipif(not (DATA / FOLDER).exists(), reason="no test data")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, str(DATA / FOLDER))
    want = duck(FOLDER).execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, got.collect()) == rows_of(names, want.fetchall())


#: Queries that SQL does not express; plain loops stand for it in the tests of the operators.
WITHOUT_SQL = {"n7_final", "n_scanned_pages", "w89_normalised"}


def test_all_others_have_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == WITHOUT_SQL


def test_staged_cleaning_on_the_table(spark):
    """Ids are those of the pages that the stages keep, once each; no text is blank, none holds what the last stages take out."""
    got = catalog.QUERIES["n_scanned_pages"](spark, str(DATA / FOLDER)).collect()
    kept = {r["page_id"] for r in catalog.QUERIES["n2_without_annexes"](spark, str(DATA / FOLDER)).collect()}
    assert len({r["page_id"] for r in got}) == len(got) > 0 and {r["page_id"] for r in got} <= kept
    for r in got:
        t = r["text"]
        assert t is None or (t.strip() and not set("<>^~|\ufffd") & set(t) and "  " not in t and "\n\n\n" not in t)
