"""References read with the variables that hold at each place."""

import pytest
from pyspark.sql import functions as F

from weftgraph.functions.expressions import scoped_references

CASES = {
    "VAR x = 1 RETURN [x] + x": {("measure", None, "x")},
    "COUNTROWS(Sales)": {("table", "Sales", None)},
    "VAR Sales = FILTER(Sales, Sales[Qty] > 1) RETURN COUNTROWS(Sales)": {("table", "Sales", None), ("column", "Sales", "Qty")},
    "VAR t = ALL(Dates) VAR u = COUNTROWS(t) RETURN u + COUNTROWS(Dates) + t[Day]": {("table", "Dates", None)},
    "SUMX(Sales, VAR Dates = Sales[Qty] RETURN Dates * 2) + COUNTROWS(Dates)": {("table", "Sales", None), ("column", "Sales", "Qty"), ("table", "Dates", None)},
    "VAR a = (VAR b = 1 RETURN b + A) RETURN a + b": {("table", "A", None), ("table", "b", None)},
    "IF(VAR q = 1 RETURN q, q, 'q') + \"q\" // q\n + 'Odd ''name'''[C]": {("table", "q", None), ("column", "Odd 'name'", "C")},
    "VAR T = 1 RETURN 't'[c] + t[c] + [t]": {("column", "t", "c"), ("measure", None, "t")},
    "NOT TRUE() && x1 IN {1, 2}": {("table", "x1", None)},
    "": set(), None: None,
}


@pytest.mark.parametrize("formula", CASES)
def test_scopes(spark, formula):
    got = spark.createDataFrame([(formula,)], "f string").select(scoped_references(F.col("f"))).first()[0]
    assert CASES[formula] is None or {tuple(r) for r in got or []} == CASES[formula]
