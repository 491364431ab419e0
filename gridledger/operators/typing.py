"""Typing of formula cells: each workbook is one group (tens of thousands of cells), evaluated once its precedents are settled."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from gridledger.functions.dimensions import Context, Value, evaluate

OUT = "workbook string, coord string, kind string, scale string, unit string, currency string, refusal string, source string"
_REF = re.compile(r"\$?([A-Za-z]{1,3})\$?(\d+)(?::\$?([A-Za-z]{1,3})\$?(\d+))?")


def _number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def coords(reference: str) -> list[str]:
    """The cells of a reference, by rows."""
    a, r, b, s = _REF.fullmatch(reference).groups()
    if not b:
        return [f"{a.upper()}{int(r)}"]
    left, right = sorted((_number(a), _number(b)))
    top, bottom = sorted((int(r), int(s)))
    return [f"{_letters(c)}{row}" for row in range(top, bottom + 1) for c in range(left, right + 1)]


def settle(cells: list[dict]) -> list[tuple]:
    """(coord, kind, scale, unit, currency, refusal, source) of every cell of one workbook.

    cells: coord, formula (or None), kind, scale, unit, currency as stated. Formulas wait for the cells they read; those on a
    cycle, or that read one, are refused. Money without a scale is an unknown, settled by what formulas require of it.
    """
    ctx, formula, order = Context(), {}, []
    for i, c in enumerate(cells):
        at = c["coord"].upper()
        if c.get("formula"):
            formula[at] = c["formula"]
        else:
            open_ = c.get("kind") == "money" and not c.get("scale")
            ctx.cell[at] = Value(kind=c.get("kind"), scale=c.get("scale"), unit=c.get("unit"), currency=c.get("currency"), unknown=i if open_ else None)
    reads = {at: [x for m in _REF.finditer(re.sub(r'"[^"]*"', "", f)) for x in coords(m[0])] for at, f in formula.items()}
    waiting = {at: {x for x in r if x in formula} for at, r in reads.items()}
    readers: dict[str, list[str]] = {}
    for at, r in waiting.items():
        for x in r:
            readers.setdefault(x, []).append(at)
    ready = sorted(at for at, w in waiting.items() if not w)
    while ready:
        at = ready.pop()
        ctx.cell[at] = evaluate(formula[at], ctx, lambda ref: [ctx.cell[x] for x in coords(ref) if x in ctx.cell])
        order.append(at)
        for x in readers.get(at, ()):
            waiting[x].discard(at)
            if not waiting[x]:
                ready.append(x)
    out = []
    for c in cells:
        at = c["coord"].upper()
        v = ctx.cell.get(at, Value(refusal="cycle"))
        scale = v.scale or (ctx.settled(v.unknown) if v.unknown is not None else None)
        out.append((c["coord"], v.kind, scale, v.unit, v.currency, v.refusal or (None if v.kind or not c.get("formula") else "untypable"), "derived" if c.get("formula") else "input"))
    return out


def type_workbooks(cells: DataFrame) -> DataFrame:
    """cells (workbook, coord, formula, kind, scale, unit, currency) with what every cell is found to be."""

    def one(pdf):
        import pandas as pd

        rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
        got = settle(rows)
        return pd.DataFrame([(rows[0]["workbook"], *r) for r in got], columns=["workbook", "coord", "kind", "scale", "unit", "currency", "refusal", "source"])

    return cells.groupBy("workbook").applyInPandas(one, OUT)
