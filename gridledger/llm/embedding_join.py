"""Embedding near-duplicates by an epsilon grid order join.

Cosine >= c between unit vectors is distance <= eps = sqrt(2 - 2c). Vectors are projected on the leading principal axes of
the whole table; their grid cells of side eps give an order in which close vectors are near each other. The ordered
sequence is cut into intervals, each with the box of its projections. Interval pairs are joined recursively: two runs of
intervals whose boxes are more than eps apart in the projected space hold no link and are skipped; single pairs are
compared by tasks, which go on the same way down to blocks and test the rest in double precision.

Equal vectors of a label are one class with a count, so that groups of copies cost one comparison. Vectors of different
length or label are never compared. Null, zero or non-finite vectors and vectors of a null label link with nothing; so do
rows whose vec_id is null (component null, kept). Rows that repeat a vec_id are vectors of their own.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.llm.shared import components, cut, forest, ready

AXES = 8
#: Rows of an interval at least, and intervals of a table at most (their boxes are on the driver), and rows of a block.
INTERVAL, MOST_INTERVALS, BLOCK = 1024, 4096, 256
#: Slack for rounding, so that no skipped block holds a link.
SLACK = 1e-6


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that may link, as vec_id, label, v (array of double)."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & fine).select("vec_id", "label", v.alias("v"))


def unit(rows) -> np.ndarray:
    x = np.array(rows, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square over- or underflows
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """[dimensions, axes] for each vector length: leading eigenvectors of the covariance of all unit vectors."""

    def run(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for b in batches:
            rows = b.column("v").to_pylist()
            for d in {len(x) for x in rows}:
                u = unit([x for x in rows if len(x) == d])
                u = np.hstack([u, np.ones((len(u), 1))])
                sums[d] = sums.get(d, 0) + u.T @ u
        for d, s in sums.items():
            i, j = np.indices(s.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, d)), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(s.ravel())], names=["d", "i", "j", "x"])

    total: dict[int, np.ndarray] = {}
    for r in classes.select("v").mapInArrow(run, "d bigint, i bigint, j bigint, x double").groupBy("d", "i", "j").agg(F.sum("x").alias("x")).collect():
        total.setdefault(r.d, np.zeros((r.d + 1, r.d + 1)))[r.i, r.j] = r.x
    out = {}
    for d, s in total.items():
        n, mean = s[d, d], s[d, :d] / s[d, d]
        _, vectors = np.linalg.eigh(s[:d, :d] / n - np.outer(mean, mean))
        out[d] = vectors[:, ::-1][:, : min(AXES, d)]
    return out


def _far(lo_a, hi_a, lo_b, hi_b, eps: float):
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return (gap * gap).sum(-1) > (eps + SLACK) ** 2


def join_intervals(lo: np.ndarray, hi: np.ndarray, eps: float) -> list[tuple[int, int]]:
    """Pairs i <= j of a sequence's intervals that may hold links: the recursive join of the sequence with itself."""
    if not len(lo):
        return []
    boxes = {}

    def box(a, b):
        if (a, b) not in boxes:
            boxes[a, b] = lo[a:b].min(0), hi[a:b].max(0)
        return boxes[a, b]

    out, todo = [], [(0, len(lo), 0, len(lo))]
    while todo:
        a, b, c, d = todo.pop()
        if _far(*box(a, b), *box(c, d), eps):
            continue
        if b - a == 1 and d - c == 1:
            out.append((a, c))
        elif (a, b) == (c, d):
            m = (a + b) // 2
            todo += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]
    return out


def link_pair(u, p, n, same: bool, cosine: float, eps: float):
    """Links between two intervals: u (unit vectors), p (projections), n (copies) of each. Gives what each row gains, and links."""
    gain = [np.zeros(len(x), np.int64) for x in u]
    left, right = [], []
    cuts = [range(0, len(x), BLOCK) for x in u]
    box = [[(x[s : s + BLOCK].min(0), x[s : s + BLOCK].max(0)) for s in c] for x, c in zip(p, cuts)]
    for i, s in enumerate(cuts[0]):
        for j, t in enumerate(cuts[1]):
            if same and j < i or _far(*box[0][i], *box[1][j], eps):
                continue
            near = u[0][s : s + BLOCK] @ u[1][t : t + BLOCK].T >= cosine
            if same and i == j:
                near = np.triu(near, 1)
            a, b = np.nonzero(near)
            np.add.at(gain[0], a + s, n[1][b + t])
            np.add.at(gain[1], b + t, n[0][a + s])
            left.append(a + s)
            right.append(b + t)
    return gain, np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])


def cosine_links(classes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """From classes (rep, label, v, n): gains (rep, gain: copies of other classes linked) and forest edges (a, b) of reps."""
    spark, eps = classes.sparkSession, math.sqrt(max(0.0, 2 - 2 * cosine))
    axes = spark.sparkContext.broadcast(principal_axes(classes))

    def cells(batches):
        import pyarrow as pa

        for b in batches:
            rows = b.column("v").to_pylist()
            d = np.array([len(x) for x in rows], np.int32)
            cell = [None] * len(rows)
            for k in np.unique(d):
                at = np.flatnonzero(d == k)
                grid = np.floor(unit([rows[i] for i in at]) @ axes.value[int(k)] / (eps or 1)).astype(np.int32)
                for i, g in zip(at, grid.tolist()):
                    cell[i] = g
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rep", "label", "v", "n")), pa.array(d), pa.array(cell, pa.list_(pa.int32()))], names=["rep", "label", "v", "n", "d", "cell"])

    kind = dict(classes.dtypes)["label"]
    ordered = cut(classes.mapInArrow(cells, f"rep bigint, label {kind}, v array<double>, n bigint, d int, cell array<int>"))
    total = ordered.count()
    size = max(INTERVAL, -(-total // MOST_INTERVALS))
    keys = ["label", "d", "cell", "rep"]

    def intervals(batches):
        import pyarrow as pa

        part, k, rest = TaskContext.get().partitionId(), 0, []

        def emit(rows):
            nonlocal k
            d = rows[0]["d"]
            u = unit([r["v"] for r in rows])
            p = u @ axes.value[d]
            k += 1
            return pa.RecordBatch.from_pydict(
                {
                    "id": pa.array([part << 32 | k], pa.int64()), "label": pa.array([rows[0]["label"]], label_type), "d": pa.array([d], pa.int32()),
                    "reps": [np.array([r["rep"] for r in rows], "<i8").tobytes()], "n": [np.array([r["n"] for r in rows], "<i8").tobytes()], "u": [u.astype("<f8").tobytes()],
                    "lo": pa.array([p.min(0).tolist()], pa.list_(pa.float64())), "hi": pa.array([p.max(0).tolist()], pa.list_(pa.float64())),
                }
            )

        for b in batches:
            label_type = b.schema.field("label").type
            for r in b.to_pylist():
                if rest and ((r["label"], r["d"]) != (rest[0]["label"], rest[0]["d"]) or len(rest) >= size):
                    yield emit(rest)
                    rest = []
                rest.append(r)
        if rest:
            yield emit(rest)

    parts = max(1, -(-total // (4 * size)))
    cut_up = cut(ordered.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(intervals, f"id bigint, label {kind}, d int, reps binary, n binary, u binary, lo array<double>, hi array<double>"))
    runs: dict = {}
    for r in cut_up.select("id", "label", "d", "lo", "hi").collect():  # at most MOST_INTERVALS, and one for each partition and label
        runs.setdefault((r.label, r.d), []).append((r.id, r.lo, r.hi))
    pairs = []
    for run in runs.values():
        run.sort()
        pairs += [(run[i][0], run[j][0]) for i, j in join_intervals(np.array([x[1] for x in run]), np.array([x[2] for x in run]), eps)]
    side = lambda x: cut_up.select(F.col("id").alias(x), F.col("d").alias(f"d_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in ("reps", "n", "u")))
    todo = spark.createDataFrame(pairs, "i bigint, j bigint").repartition(max(1, -(-len(pairs) // 8)))

    def compare(batches):
        import pyarrow as pa

        for b in batches:
            for r in (b.slice(k, 1).to_pylist()[0] for k in range(b.num_rows)):
                same = r["i"] == r["j"]
                reps = [np.frombuffer(r[f"reps_{x}"], "<i8") for x in "ij"]
                n = [np.frombuffer(r[f"n_{x}"], "<i8") for x in "ij"]
                u = [np.frombuffer(r[f"u_{x}"], "<f8").reshape(len(y), -1) for x, y in zip("ij", reps)]
                gain, a, c = link_pair(u, [x @ axes.value[r["d_i"]] for x in u], n, same, cosine, eps)
                if not len(a):
                    continue
                edges = forest(reps[0][a], reps[1][c])
                rep, got = (reps[0], gain[0] + gain[1]) if same else (np.concatenate(reps), np.concatenate(gain))
                rep, got = rep[got > 0], got[got > 0]
                blank = lambda k: pa.nulls(k, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([pa.array(rep), blank(len(edges[0]))]), pa.concat_arrays([pa.array(got), blank(len(edges[0]))]), pa.concat_arrays([blank(len(rep)), pa.array(edges[0])]), pa.concat_arrays([blank(len(rep)), pa.array(edges[1])])],
                    names=["rep", "gain", "a", "b"],
                )

    found = cut(todo.join(side("i"), "i").join(side("j"), "j").mapInArrow(compare, "rep bigint, gain bigint, a bigint, b bigint"))
    gains = found.where("rep is not null").groupBy("rep").agg(F.sum("gain").alias("gain"))
    return gains, found.where("a is not null").select("a", "b")


def near_duplicates(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label)."""
    ready(vectors.sparkSession)
    rows = usable(vectors)
    classes = cut(rows.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).select(F.col("rep").cast("bigint").alias("rep"), "label", "v", "n"))
    gains, edges = cosine_links(classes, cosine)
    roots = components(edges)
    found = classes.join(gains, "rep", "left").join(roots, classes["rep"] == roots["node"], "left")
    found = cut(found.select("label", "v", (F.col("n") - 1 + F.coalesce("gain", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id")))
    linked = rows.join(found, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = vectors.select("vec_id", F.col("label"), F.col("embedding"))
    v = F.col("embedding").cast("array<double>")
    bad = F.col("vec_id").isNull() | F.col("label").isNull() | v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    rest = alone.where(F.coalesce(bad, F.lit(True))).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").cast("bigint").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
