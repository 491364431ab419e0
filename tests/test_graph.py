"""Fixpoints run until nothing changes, at any depth."""

import random

import pytest

from gridledger.operators import graph
from gridledger.queries.graphs import gr6


def shuffled(spark):
    """Bytes that the session's shuffles have written so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_history_of_a_long_chain(spark, tmp_path):
    """One customer of 450 orders: the old bound of 200 rounds gave 201 of them."""
    rows = [(k, 1, f"2020-01-01T{k:05d}") for k in range(50, 500)] + [(550, 2, "2020"), (552, 2, "2021")]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderdate string").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(map(tuple, gr6(spark, str(tmp_path)).collect()))
    assert got == [(s, k, k - s) for s in range(50, 500, 50) for k in range(s, 500)] + [(550, 550, 0), (550, 552, 1)]


def test_history_of_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (5, 3)], "a bigint, b bigint")
    starts = spark.createDataFrame([(1,), (4,), (9,)], "start bigint")
    want = sorted(map(tuple, graph.lineage(edges, starts).collect()))
    assert sorted(map(tuple, graph.history(edges, starts).collect())) == want
    assert (1, 5, 4) in want and (9, 9, 0) in want and len(want) == 9


def test_levels_leave_out_only_what_reaches_a_cycle(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (5, 2), (7, 8), (8, 7), (6, 7)], "a bigint, b bigint")
    assert sorted(map(tuple, graph.levels(edges).collect())) == [(2, 0), (3, 1), (4, 2), (5, 3)]


def test_words_beside_a_region_join_it():
    """A column of units no longer than the region, then a second one; a run that goes on past the region, or holds a number, stays out."""
    units = {(r, 3) for r in (1, 2, 3)} | {(r, 4) for r in (2, 3)}
    assert graph.grown([[1, 1, 3, 2]], units, set()) == [[1, 1, 3, 4]]
    assert graph.grown([[1, 1, 3, 2]], {(r, 3) for r in range(1, 6)}, set()) == [[1, 1, 3, 2]]
    assert graph.grown([[1, 1, 3, 2]], {(1, 3), (3, 3)}, {(2, 3)}) == [[1, 1, 3, 2]]
    assert graph.grown([[2, 2, 3, 3]], {(1, 2), (4, 3), (2, 1), (3, 4)}, set()) == [[1, 1, 4, 4]]
    assert graph.grown([[1, 1, 1, 1]], {(1, c) for c in range(2, 10)}, set()) == [[1, 1, 1, 5]]


def test_regions_of_a_grid(spark):
    rows = [("x", r, c, True) for r, c in ((1, 1), (1, 3), (3, 3), (9, 9), (9, 10))] + [("y", 1, 1, True), ("y", 2, 2, False), ("y", 3, 3, True)]
    got = graph.regions(spark.createDataFrame(rows, "sheet string, row int, col int, number boolean")).collect()
    assert [(r.sheet, r.top, r.left, r.bottom, r.right, r.cells, r.numbers) for r in got] == [("x", 1, 1, 3, 3, 3, 3)]


def blocks(cells, reach, least):
    """The regions of {(row, col): number} by looking at all cells."""
    left, out = set(cells), []
    while left:
        todo = [min(left)]
        own = set(todo)
        while todo:
            r, c = todo.pop()
            more = {(r + i, c + j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)} & left - own
            own |= more
            todo += more
        left -= own
        if sum(cells[x] for x in own) >= least:
            rows, cols = zip(*own, strict=True)
            out.append((*min(own), min(rows), min(cols), max(rows), max(cols), len(own), sum(cells[x] for x in own)))
    return sorted(out)


@pytest.mark.parametrize("reach", [1, 2, 3])
def test_regions_across_tiles_are_whole(spark, reach):
    """Cells about the corners of tiles, a line through several tiles, and a small sheet; some cells are given twice."""
    pick, sheets = random.Random(reach), {}
    for sheet, (row, col) in {"a": (256, 256), "b": (-256, 768), "c": (0, 0), "d": (256, 0)}.items():
        sheets[sheet] = {(row + pick.randint(-12, 12), col + pick.randint(-12, 12)): pick.random() < 0.6 for _ in range(110 // reach)}
    sheets["line"] = {(7, c): True for c in range(-600, 1200, reach)} | {(7 + r, 256): False for r in range(0, 600, reach)}
    rows = [(s, r, c, n) for s, own in sheets.items() for (r, c), n in own.items()]
    rows += [(s, r, c, False) for s, r, c, n in rows[::3]] + [(None, 1, 1, True), ("c", None, 1, True), ("c", 1, None, True)]
    pick.shuffle(rows)
    got = graph.regions(spark.createDataFrame(rows, "sheet string, row int, col int, number boolean"), reach, 3).collect()
    want = sorted((s, *x) for s, own in sheets.items() for x in blocks(own, reach, 3))
    assert sorted((r.sheet, r.region.row, r.region.col, r.top, r.left, r.bottom, r.right, r.cells, r.numbers) for r in got) == want
    assert len({x[0] for x in want}) == 5


def test_regions_move_a_cell_a_few_times(spark):
    """The old way moved each cell to its 25 neighbours and each link in every round: more than 300 bytes a cell."""
    cells = spark.range(200_000).selectExpr("id div 30 as sheet", "cast(id * 7 % 50 as int) as row", "cast(id % 7 as int) as col", "id % 4 > 0 as number").localCheckpoint()
    before = shuffled(spark)
    graph.regions(cells).count()
    assert 0 < shuffled(spark) - before < 40 * 200_000


def test_fringe_of_many_sheets_is_that_of_each(spark):
    """Sheets pass by the batch, not one by one; before, each was a group of pandas, and a cell without a place failed."""
    pick, cells, boxes, want = random.Random(5), [], [], []
    for sheet in range(40):
        own = sorted([t, left, t + pick.randint(0, 3), left + pick.randint(0, 3)] for t, left in ((pick.randint(1, 3), pick.randint(1, 3)), (pick.randint(8, 10), pick.randint(3, 8))))
        at = {(pick.randint(0, 12), pick.randint(0, 12)): pick.random() < 0.2 for _ in range(70)}
        cells += [(sheet, r, c, n) for (r, c), n in at.items()] + [(sheet, None, 1, False), (sheet, 1, None, True)]
        if sheet % 5:
            boxes += [(sheet, *x) for x in own]
            free = {x: n for x, n in at.items() if not any(t <= x[0] <= b and l <= x[1] <= w for t, l, b, w in own)}
            want += [(sheet, *x) for x in graph.grown(own, {x for x, n in free.items() if not n}, {x for x, n in free.items() if n})]
    pick.shuffle(cells)
    df = graph.absorb_fringe(spark.createDataFrame(cells, "sheet long, row int, col int, number boolean"), spark.createDataFrame(boxes, "sheet long, top int, left int, bottom int, right int"))
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert sorted(want) != sorted(boxes)
    assert "InPandas" not in df._jdf.queryExecution().executedPlan().toString()


def test_scales_that_are_asked_once(spark):
    same = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    asked = spark.createDataFrame([(3, "lakh"), (1, "lakh"), (5, "lakh"), (6, "crore"), (9, "unit")], "node long, scale string")
    got = {r.node: (r.component, r.scale) for r in graph.settled_scales(same, asked).collect()}
    assert got == {1: (1, "lakh"), 2: (1, "lakh"), 3: (1, "lakh"), 5: (5, None), 6: (5, None), 9: (9, "unit")}
