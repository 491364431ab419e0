import pytest

from gridledger.operators.typing import coords, settle, type_workbooks


def cell(coord, kind=None, scale=None, unit=None, currency=None, formula=None):
    return {"coord": coord, "kind": kind, "scale": scale, "unit": unit, "currency": currency, "formula": formula}


Q, R = cell("A1", "quantity", "unit", "kwh"), cell("B1", "rate", "unit", "kwh", "INR")
RUPEES, LAKH, OPEN = cell("A1", "money", "unit", None, "INR"), cell("A1", "money", "lakh", None, "INR"), cell("A1", "money", None, None, "INR")


@pytest.mark.parametrize(
    "inputs, formula, want",
    [
        ([Q, R], "=A1*B1", ("money", "unit", None, "INR", None)), ([Q, cell("B1", "money", "unit")], "=A1+B1", (None, None, None, None, "kind_conflict")), ([RUPEES], "=A1/100000", ("money", "lakh", None, "INR", None)),
        ([RUPEES], "=A1/10^7", ("money", "crore", None, "INR", None)), ([LAKH], "=A1*1e5", ("money", "unit", None, "INR", None)), ([RUPEES], "=A1*100000", (None, None, None, None, "kind_conflict")),
        ([cell("A1", "ratio", "unit")], "=A1*100", ("percent", "unit", None, None, None)), ([RUPEES, cell("B1", "money", "unit")], "=ROUND(A1/B1,2)", ("ratio", "unit", None, None, None)),
        ([RUPEES, cell("B1", "quantity", "unit", "acre")], "=A1/B1", ("rate", "unit", "acre", "INR", None)), ([RUPEES, cell("A2", "money", "unit")], "=SUM(A1:A3)", ("money", "unit", None, "INR", None)),
        ([RUPEES], "=A1/0", (None, None, None, None, "untypable")), ([RUPEES], "=VLOOKUP(A1,B1,2)", (None, None, None, None, "untypable")), ([RUPEES, cell("B1", "money", "unit", None, "USD")], "=A1+B1", (None, None, None, None, "kind_conflict")),
        ([RUPEES, cell("B1", "percent", "unit")], "=A1*B1", ("money", "unit", None, "INR", None)), ([Q], "=1/A1", (None, None, None, None, "untypable")), ([RUPEES], "=-(A1)+5", ("money", "unit", None, "INR", None)),
    ],
)
def test_algebra(inputs, formula, want):
    assert settle([*inputs, cell("Z9", formula=formula)])[-1][1:6] == want


def test_unstated_scales_are_settled_by_what_formulas_require():
    rows = settle([OPEN, cell("B1", "money", "lakh"), cell("C1", formula="=A1+B1")])
    assert rows[0][2] == "lakh" and rows[2][1:3] == ("money", "lakh")
    rows = settle([OPEN, cell("B1", "money", "lakh"), cell("C1", "money", "crore"), cell("D1", formula="=A1+B1"), cell("E1", formula="=A1+C1")])
    assert rows[0][2] is None
    assert settle([OPEN, cell("C1", formula="=A1/100000")])[0][2] == "unit"


def test_unknown_scales_that_are_added_are_one():
    rows = settle([cell("A1", "money"), cell("B1", "money"), cell("C1", formula="=A1+B1"), cell("D1", "money", "crore"), cell("E1", formula="=B1+D1")])
    assert rows[0][2] == rows[1][2] == rows[2][2] == "crore"


def test_money_times_days_or_a_rate_stays_that_money():
    days, dollars = cell("B1", "quantity", "unit", "days"), cell("B1", "rate", "unit", None, "USD")
    assert settle([OPEN, days, cell("C1", formula="=A1*B1")])[-1][1:6] == ("money", None, None, "INR", None)
    assert settle([LAKH, dollars, cell("C1", formula="=A1*B1")])[-1][1:6] == ("money", "lakh", None, "INR", None)


def test_cycles_and_their_readers_are_refused():
    rows = settle([cell("A1", formula="=B1"), cell("B1", formula="=A1"), cell("C1", formula="=A1+1"), cell("D1", "money", "unit")])
    assert [r[5] for r in rows] == ["cycle", "cycle", "cycle", None]


def test_ranges():
    assert coords("$B$2:A1") == ["A1", "B1", "A2", "B2"] and coords("AA10") == ["AA10"]


def test_workbooks_are_typed_apart(spark):
    rows = [(w, c, f, k, s, None, None) for w in ("x", "y") for c, f, k, s in (("A1", None, "money", "unit"), ("B1", "=A1/1000", None, None))]
    got = type_workbooks(spark.createDataFrame(rows, "workbook string, coord string, formula string, kind string, scale string, unit string, currency string")).collect()
    assert sorted((r.workbook, r.coord, r.kind, r.scale, r.source) for r in got) == [(w, c, "money", s, o) for w in ("x", "y") for c, s, o in (("A1", "unit", "input"), ("B1", "thousand", "derived"))]
