"""Scans of a nation with more customers than one workbook holds."""

from pathlib import Path

import duckdb
import pytest

from cellweave.plans import fixtures
from cellweave.plans.catalogue import ORACLES, QUERIES
from test_oracles import SF, rows


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("scan_") and "customer" in ORACLES[n]))
def test_scans_of_several_workbooks(spark, monkeypatch, name):
    monkeypatch.setattr(fixtures, "PAGE", 3)
    assert fixtures.customers(spark, SF).selectExpr("max(size(rows)) AS n").first().n == 3
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.execute(ORACLES[name]).df())
