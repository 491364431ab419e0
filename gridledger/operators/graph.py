"""Graphs of edges: components, cycles, lineage, closures. Each step is a join and an aggregate; lineage is cut by checkpoints."""

from __future__ import annotations

import tempfile
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the session's folder (spark.checkpoint.dir; a local session without one gets a folder of its own)."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        path = sc.getConf().get("spark.checkpoint.dir", None)
        if not path and not sc._jsc.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="gridledger-"))
    return df.checkpoint(eager=True)


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) with each component's least node: labels spread along edges, then jump to their labels' labels."""
    one = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = cut(one.union(one.select("b", "a")).distinct())
    label = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("label").alias("low"))
        spread = label.join(near, label["node"] == near["a"], "left").select("node", F.least("label", "low").alias("label"))
        jump = spread.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = cut(spread.join(jump, "label", "left").select("node", F.least("label", "next").alias("label")))
        changed = new.join(label.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        label = new
        if not changed:
            return label.withColumnRenamed("label", "component")


def reach_a_cycle(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node): nodes from which some cycle can be reached. Nodes without an edge into what is left are peeled off until none is."""
    left = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    n = left.count()
    while True:
        left = cut(left.join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
        now = left.count()
        if now == n:
            return left.select(F.col("a").alias("node")).distinct()
        n = now


def lineage(edges: DataFrame, starts: DataFrame, depth: int | None = None, a: str = "a", b: str = "b") -> DataFrame:
    """(start, node, depth) of all nodes reached from starts (start), at their least depth, to a given depth or until nothing new is met."""
    step = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    seen = cut(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")))
    edge, k = seen, 0
    while depth is None or k < depth:
        k += 1
        nxt = edge.join(step, edge["node"] == step["a"]).select("start", F.col("b").alias("node")).distinct()
        edge = cut(nxt.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(k)))
        if not edge.head(1):
            break
        seen = cut(seen.unionByName(edge))
    return seen


def history(edges: DataFrame, starts: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """lineage() without a bound, of nodes with at most one edge out each: steps double, so a chain of n takes log2(n) rounds."""
    jump = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    if jump.groupBy("a").count().where("count > 1").head(1):
        raise ValueError("a node has several edges out")
    seen = cut(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct())
    far = 1
    while True:
        nxt = seen.join(jump, seen["node"] == jump["a"]).groupBy("start", F.col("b").alias("node")).agg(F.min(F.col("depth") + far).alias("depth"))
        new = cut(nxt.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        if not new.head(1):
            return seen
        seen = cut(seen.unionByName(new))
        jump = cut(jump.join(jump.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")))
        far *= 2


def levels(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, level): the longest path to a node without edges out; only nodes that reach a cycle have none."""
    e = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    done = cut(nodes.join(e.select(F.col("a").alias("node")), "node", "left_anti").withColumn("level", F.lit(0)))
    k = 0
    while True:
        k += 1
        rest = e.join(done.select(F.col("node").alias("a")), "a", "left_anti")
        blocked = rest.join(done.select(F.col("node").alias("b")), "b", "left_anti").select("a").distinct()
        ready = cut(rest.select("a").distinct().join(blocked, "a", "left_anti").select(F.col("a").alias("node"), F.lit(k).alias("level")))
        if not ready.head(1):
            return done
        done = cut(done.unionByName(ready))


def settled_scales(same: DataFrame, required: DataFrame) -> DataFrame:
    """(node, component, scale): unknowns joined by same (a, b), and the scale that required (node, scale) asks of their component; null if
    none or several are asked. Nodes that stand in one of the two tables only are components too."""
    joined = connected(same)
    alone = required.select("node").distinct().join(joined.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    every = cut(joined.unionByName(alone))
    asked = every.join(required, "node").groupBy("component").agg(F.min("scale").alias("lo"), F.max("scale").alias("hi"))
    scales = asked.select("component", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("scale"))
    return every.join(scales, "component", "left").select("node", "component", "scale")


TILE = 512  # rows and columns of a tile of regions(). Tiles stand about zero: cells up to 255 rows and columns share one


def regions(cells: DataFrame, reach: int = 2, least: int = 3) -> DataFrame:
    """Blocks of cells (sheet, row, col, number: whether it is one) within `reach` rows and columns of each other that hold `least` numbers:
    sheet, region (its first cell, by row, as row and column), top, left, bottom, right, cells, numbers.

    A tile's blocks are found by sorting; those that reach a tile's edge meet by equal places, so a sheet of any size is dealt by tiles.
    """
    if not 0 < reach < TILE:
        raise ValueError(f"reach: 1 to {TILE - 1}")
    kind, row, col = dict(cells.dtypes), F.col("row"), F.col("col")
    tile = lambda c: F.floor((c + TILE // 2) / TILE)
    given = cells.where("sheet is not null and row is not null and col is not null").groupBy("sheet", "row", "col").agg(F.max("number").alias("number"))
    dealt = given.select("sheet", row.cast("int").alias("row"), col.cast("int").alias("col"), "number").repartition("sheet", tile(row.cast("bigint")), tile(col.cast("bigint")))
    ordered = dealt.sortWithinPartitions("sheet", tile(row.cast("bigint")), tile(col.cast("bigint")), "row", "col")
    out = f"sheet {kind['sheet']}, row bigint, col bigint, top bigint, left bigint, bottom bigint, right bigint, cells bigint, numbers bigint, edge array<struct<row: bigint, col: bigint>>"
    local = cut(ordered.mapInArrow(lambda batches: _blocks(batches, reach, least), out))
    open_ = local.where(F.size("edge") > 0)
    if open_.head(1):
        node = F.struct("sheet", "row", "col")
        border = cut(open_.select(node.alias("a"), F.explode("edge").alias("at")).select("a", "a.sheet", "at.row", "at.col"))
        near = [(r, c) for r in range(-reach, reach + 1) for c in range(-reach, reach + 1)]
        moves = F.explode(F.array(*(F.struct((row + r).alias("r"), (col + c).alias("c")) for r, c in near))).alias("to")
        over = (tile(row) != tile(F.col("to.r"))) | (tile(col) != tile(F.col("to.c")))
        beside = border.select("a", "sheet", "row", "col", moves).where(over).select("a", "sheet", F.col("to.r").alias("row"), F.col("to.c").alias("col"))
        member = connected(beside.join(border.withColumnRenamed("a", "b"), ["sheet", "row", "col"]).select("a", "b"))
        own = open_.drop("edge").withColumn("node", node).join(member, "node", "left").withColumn("first", F.coalesce("component", "node"))
        sides = [F.min("top").alias("top"), F.min("left").alias("left"), F.max("bottom").alias("bottom"), F.max("right").alias("right")]
        joined = own.groupBy("first").agg(*sides, F.sum("cells").alias("cells"), F.sum("numbers").alias("numbers")).select("first.sheet", "first.row", "first.col", "top", "left", "bottom", "right", "cells", "numbers")
        local = local.where(F.size("edge") == 0).drop("edge").unionByName(joined)
    down, across = (lambda c, n=n: F.col(c).cast(kind[n]).alias(c) for n in ("row", "col"))
    return local.where(F.col("numbers") >= least).select("sheet", F.struct(down("row"), across("col")).alias("region"), down("top"), across("left"), down("bottom"), across("right"), "cells", "numbers")


def _groups(batches, starts, rows: int = 1 << 18):
    """Arrow batches of sorted rows as tables of whole groups, of some `rows` rows where groups are not larger. starts: where groups start in a table."""
    import pyarrow as pa

    held, n, most = [], 0, rows
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= most:
            t = pa.Table.from_batches(held).combine_chunks()
            last = int(starts(t).nonzero()[0][-1])
            if last:
                yield t.slice(0, last)
            held, n = t.slice(last).to_batches(), n - last
            most = max(rows, 2 * n)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _changes(*columns):
    """Whether a row differs from the one before it in any of the columns (Arrow or numpy); the first does."""
    import numpy as np
    import pyarrow as pa

    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        if not isinstance(c, np.ndarray):
            one = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
            c = one.dictionary_encode(null_encoding="encode").indices.to_numpy()
        out[1:] |= c[1:] != c[:-1]
    return out


def _first_cells(tile, row, col, reach: int):
    """For each of the cells, in order by tile, row and column, the place of the first one that it hangs together with. tile: whether one starts.

    Of the cells within reach on another line, the first and the last do: between them is at most one gap that the line itself does not bridge.
    """
    import numpy as np

    n = len(row)
    new = tile.copy()
    new[1:] |= row[1:] != row[:-1]
    line, at = np.cumsum(new) - 1, np.flatnonzero(new)
    line_row, line_tile = row[at], np.cumsum(tile)[at]
    beside = np.flatnonzero(~new[1:] & (np.diff(col) <= reach))
    a, b = [beside], [beside + 1]
    c = col - col.min() + reach
    wide = int(c.max()) + reach + 1
    key = line * wide + c
    for j in range(1, min(reach, len(at) - 1) + 1):
        near = np.zeros(len(at), bool)
        near[:-j] = (line_tile[j:] == line_tile[:-j]) & (line_row[j:] - line_row[:-j] <= reach)
        i = np.flatnonzero(near[line])
        lo, hi = np.searchsorted(key, key[i] + j * wide - reach), np.searchsorted(key, key[i] + j * wide + reach, "right") - 1
        hit = lo <= hi
        a += [i[hit], i[hit]]
        b += [lo[hit], hi[hit]]
    a, b, root = np.concatenate(a), np.concatenate(b), np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return root


def _blocks(batches, reach: int, least: int):
    """The blocks of each tile, with their cells at its edge; those that hold too few numbers only if they have such cells."""
    import numpy as np
    import pyarrow as pa

    ints = lambda t, name: t[name].to_numpy().astype(np.int64)
    tile = lambda x: (x + TILE // 2) // TILE
    starts = lambda t: _changes(t["sheet"], tile(ints(t, "row")), tile(ints(t, "col")))
    for t in _groups(batches, starts):
        row, col = ints(t, "row"), ints(t, "col")
        number = t["number"].fill_null(False).to_numpy().astype(np.int64)
        root = _first_cells(starts(t), row, col, reach)
        order = np.argsort(root, kind="stable")
        at = np.flatnonzero(np.diff(root[order], prepend=-1))
        most, least_, total = (lambda x, f=f: f.reduceat(x[order], at) for f in (np.maximum, np.minimum, np.add))
        edge = np.zeros(len(row), bool)
        for x in (row, col):
            place = (x + TILE // 2) % TILE
            edge |= (place < reach) | (place >= TILE - reach)
        numbers, edges = total(number), total(edge.astype(np.int64))
        keep = (numbers >= least) | (edges > 0)
        first, side = root[order][at][keep], order[edge[order]]
        places = pa.StructArray.from_arrays([pa.array(row[side]), pa.array(col[side])], ["row", "col"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(edges[keep])]).astype(np.int32)), places)
        columns = {"row": row[first], "col": col[first], "top": row[first], "left": least_(col)[keep], "bottom": most(row)[keep], "right": most(col)[keep], "cells": np.diff(at, append=len(row))[keep], "numbers": numbers[keep]}
        sheet = t["sheet"].combine_chunks().take(pa.array(first))
        yield pa.RecordBatch.from_arrays([sheet, *map(pa.array, columns.values()), lists], ["sheet", *columns, "edge"])


def grown(boxes: list[list[int]], texts: set[tuple[int, int]], numbers: set[tuple[int, int]], rounds: int = 4) -> list[list[int]]:
    """Boxes [top, left, bottom, right] of one sheet with the words along their edges: in turn left, right, above and below, as long as a round
    gains, the runs of free cells on the line outside that are words only and no longer than the edge. texts and numbers: free cells."""
    texts, out = set(texts), []
    for top, left, bottom, right in boxes:
        for _ in range(rounds):
            gained = False
            for side in range(4):
                line = (left - 1, right + 1, top - 1, bottom + 1)[side]
                lo, hi = (top, bottom) if side < 2 else (left, right)
                at = (lambda k: (k, line)) if side < 2 else (lambda k: (line, k))
                run = _runs(at, lo, hi, texts, numbers)
                if run:
                    gained, texts = True, texts - run
                    left, right, top, bottom = (line if side == k else x for k, x in enumerate((left, right, top, bottom)))
            if not gained:
                break
        out.append([top, left, bottom, right])
    return out


def _runs(at, lo: int, hi: int, texts: set, numbers: set) -> set:
    """The cells of the runs on a line that lie within lo to hi and hold no number."""
    out, k, free = set(), lo, lambda k: at(k) in texts or at(k) in numbers
    while free(k - 1):  # a run that comes in from outside lies not within
        k -= 1
    while k <= hi:
        end = k
        while free(end):
            end += 1
        run = {at(i) for i in range(k, end)}
        if run and k >= lo and end - 1 <= hi and not run & numbers:
            out |= run
        k = end + 1
    return out


def absorb_fringe(cells: DataFrame, boxes: DataFrame, rounds: int = 4) -> DataFrame:
    """boxes (sheet, top, left, bottom, right) of a sheet's regions with the words beside them; cells (sheet, row, col, number). A sheet stays
    whole, as its boxes take words in turn; many sheets pass in one Arrow batch."""
    own = boxes.select("sheet", F.lit(0).alias("kind"), *(F.col(c).cast("int").alias(x) for c, x in zip(("top", "left", "bottom", "right"), "abcd", strict=True)))
    place = cells.where("row is not null and col is not null").select("sheet", F.when(F.col("number"), 2).otherwise(1).alias("kind"), F.col("row").cast("int").alias("a"), F.col("col").cast("int").alias("b"), F.lit(0).alias("c"), F.lit(0).alias("d"))
    both = own.unionByName(place).repartition("sheet").sortWithinPartitions("sheet", "kind", "a", "b", "c", "d")
    out = f"sheet {dict(boxes.dtypes)['sheet']}, top int, left int, bottom int, right int"
    return both.mapInArrow(lambda batches: _fringed(batches, rounds), out)


def _fringed(batches, rounds: int):
    """The grown boxes of whole sheets; a sheet's boxes stand before its words, and these before its numbers."""
    from itertools import pairwise

    import pyarrow as pa

    starts = lambda t: _changes(t["sheet"])
    for t in _groups(batches, starts):
        kind, a, b, c, d = (t[x].to_pylist() for x in ("kind", "a", "b", "c", "d"))
        at, got = [], []
        for lo, hi in pairwise([*starts(t).nonzero()[0].tolist(), t.num_rows]):
            first = bisect_left(kind, 1, lo, hi)
            if first == lo:
                continue
            middle = bisect_left(kind, 2, first, hi)
            own = [[a[i], b[i], c[i], d[i]] for i in range(lo, first)]
            free = [set(zip(a[i:j], b[i:j], strict=True)) for i, j in ((first, middle), (middle, hi))]
            for top, left, bottom, right in own:
                for held, i, j in zip(free, (first, middle), (middle, hi), strict=True):
                    band = range(bisect_left(a, top, i, j), bisect_right(a, bottom, i, j))
                    held.difference_update([(a[k], b[k]) for k in band if left <= b[k] <= right])
            got += grown(own, *free, rounds)
            at += [lo] * (first - lo)
        sheet = t["sheet"].combine_chunks().take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([sheet, *(pa.array([g[k] for g in got], pa.int32()) for k in range(4))], ["sheet", "top", "left", "bottom", "right"])


def peel_merge(vectors: dict[str, list[float]], threshold: float = 0.72) -> dict[str, str]:
    """Agglomerative merge of a bounded set of named centroids: the most similar pair at or above threshold merges (of equals
    the later), its centroid is the mean at unit length; each name's final group is the least name in it."""
    import numpy as np

    names = sorted(vectors)
    group = {n: [n] for n in names}
    x = {n: np.asarray(vectors[n], float) for n in names}
    unit = lambda v: v / n if (n := np.linalg.norm(v)) else v
    while True:
        live, best, pair = sorted(group), threshold, None
        for i, p in enumerate(live):
            for q in live[i + 1 :]:
                if (s := float(unit(x[p]) @ unit(x[q]))) >= best:
                    best, pair = s, (p, q)
        if not pair:
            return {n: g for g, own in group.items() for n in own}
        p, q = pair
        group[p] += group.pop(q)
        x[p] = unit(sum(unit(np.asarray(vectors[n], float)) for n in group[p]))
        del x[q]
