"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sizes are words ([^\\x20\\x09-\\x0D]+; null text: 0). A source's documents are dealt by hash into permuted blocks of about
BLOCK_DOCS documents. A source with target t and size z is taken floor(t / z) times whole, and once more up to the word
where the target is met, so that its taken words equal the rounded target; only the document at that word is taken in part.
The draws of each source (copies of blocks) are split among output shards, as many as the corpus fills, by a binary tree: at
each node, the quotas of the left half follow the multivariate hypergeometric law. Each shard then has exact quotas, takes the
next so many blocks of each source's permutation, which no other shard takes, and shuffles its documents locally by hash. What
the mix takes of a document is the sum of its rows in the shards.

A null source is a source of its own, the last. Repeated rows are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridledger.llm.shared import as_bytes, cut, ready

BLOCK_DOCS = 1024
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
#: Words of an output shard, about; shards at least and at most (the driver holds one count of each source for each; beyond, shards grow).
SHARD_WORDS, LEAST_SHARDS, MOST_SHARDS = 1 << 22, 8, 1 << 16
#: Blocks of a group of a prefix sum; groups that draws are ranked in; ranks of a tile, by which draws meet shards.
PREFIX, GROUP_BITS, TILE = 4096, 12, 64
#: The table of sources is broadcast up to this many rows; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 10_000


def sized(docs: DataFrame, seed: int, whole: bool = False) -> DataFrame:
    """doc_id, source, size in words, u: a permutation key, the same in every run; if asked, the whole row as a struct."""
    names = ["doc_id", "source", "u", *(["row"] if whole else [])]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            sizes = [len(x.split()) for x in as_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(sizes, pa.int64())], names=[*names, "size"])

    kinds = dict(docs.dtypes)
    row = [F.struct(*docs.columns).alias("row")] if whole else []
    src = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text", F.xxhash64("doc_id", F.lit(seed), "text").alias("u"), *row)
    return src.mapInArrow(run, f"doc_id {kinds['doc_id']}, source string, u bigint" + (f", row {src.schema['row'].dataType.simpleString()}" if whole else "") + ", size bigint")


def targets(sizes: dict, weights=WEIGHTS, most: float = MOST) -> dict:
    """Target words of each source: weights share the total; above `most` times its size a source stops, and the excess is shared anew."""
    order = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
    w = {k: weights[i % len(weights)] for i, k in enumerate(order)}
    left, total, out = list(order), float(sum(sizes.values())), {}
    while left:
        share = sum(w[k] for k in left)
        stop = [k for k in left if total * w[k] / share > most * sizes[k]]
        if not stop:
            return out | {k: total * w[k] / share for k in left}
        for k in stop:
            out[k] = most * sizes[k]
            total -= out[k]
            left.remove(k)
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """[shards, sources]: exact quotas of every leaf of the splitting tree. Each node draws from its own generator."""
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, np.asarray(quotas, np.int64))]
    while todo:
        lo, hi, q = todo.pop()
        if hi - lo == 1:
            out[lo] = q
            continue
        mid = (lo + hi) // 2
        n = int(q.sum()) * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(q, n, method="marginals") if len(q) and q.sum() else q * 0
        todo += [(lo, mid, left), (mid, hi, q - left)]
    return out


def numbered(draws: DataFrame, seed: int) -> DataFrame:
    """draws (s, block, copy) with rank: their place among all of the source, in the order of a hash. Ranks are counted in groups of like hashes."""
    order = F.xxhash64("s", "block", "copy", F.lit(seed))
    grouped = draws.withColumn("order", order).withColumn("g", F.shiftright("order", 64 - GROUP_BITS))
    per = grouped.groupBy("s", "g").agg(F.count("*").alias("n"))  # at most 2 ** GROUP_BITS rows a source
    before = per.select("s", "g", F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("s", "g").orderBy("order", "block", "copy"))
    return grouped.withColumn("place", place).join(before, ["s", "g"]).select("s", "block", "copy", (F.col("before") + F.col("place") - 1).alias("rank"))


def dealt_blocks(draws: DataFrame, leaf: np.ndarray) -> DataFrame:
    """(s, block, copy, shard) of draws with rank: shard k takes the next leaf[k, s] ranks of source s."""
    import pyarrow as pa

    first = leaf.cumsum(0) - leaf
    k, i = np.nonzero(leaf)
    kinds = pa.schema([("s", pa.int32()), ("shard", pa.int32()), ("first", pa.int64()), ("n", pa.int64())])
    runs = draws.sparkSession.createDataFrame(pa.table([pa.array(i, pa.int32()), pa.array(k, pa.int32()), pa.array(first[k, i]), pa.array(leaf[k, i])], schema=kinds))
    tiles = runs.withColumn("tile", F.explode(F.expr(f"sequence(first div {TILE}, (first + n - 1) div {TILE})")))
    here = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    return draws.withColumn("tile", F.expr(f"rank div {TILE}")).join(tiles, ["s", "tile"]).where(here).select("s", "block", "copy", "shard")


def mix(docs: DataFrame, weights=WEIGHTS, most: float = MOST, shards: int | None = None, seed: int = 17, with_row: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, s, block, place_in_block (which name a row), copies: array of (copy, shard, words, place),
    one for each time the mix takes the document; if `with_row`, also row, a struct of all its columns.

    place orders a shard's documents. The driver holds one row for each source (data sets, not documents) and, while it
    splits, one count for each source and shard. A source's blocks are numbered by two-level prefix sums: of documents
    within a block, of blocks within groups, of groups within a source; no task sees a whole source.
    """
    spark = ready(docs.sparkSession)
    base = cut(sized(docs, seed))
    per = base.groupBy("source").agg(F.sum("size").alias("z"), F.count("*").alias("docs")).collect()
    want = targets({r.source: int(r.z) for r in per}, weights, most)
    order = sorted((r for r in per if r.source is not None), key=lambda r: r.source) + [r for r in per if r.source is None]
    rows = []
    for i, r in enumerate(order):
        t = int(want[r.source] + 0.5)
        whole = t // int(r.z) if r.z else 0
        rows.append((i, r.source, int(r.z), float(want[r.source]), whole, t - whole * int(r.z), -(-r.docs // BLOCK_DOCS)))
    shards = shards or min(MOST_SHARDS, max(LEAST_SHARDS, -(-sum(r[2] for r in rows) // SHARD_WORDS)))
    sources = spark.createDataFrame(rows, "s int, source string, source_size bigint, target double, whole bigint, rest bigint, blocks bigint")
    unit = (F.shiftrightunsigned("u", 11).cast("double")) / float(1 << 53)
    sources = F.broadcast(sources) if len(rows) <= BROADCAST_SOURCES else sources
    placed = (sized(docs, seed, True) if with_row else base).join(sources.withColumnRenamed("source", "src"), F.col("source").eqNullSafe(F.col("src"))).drop("src").withColumn("block", F.least(F.floor(unit * F.col("blocks")), F.col("blocks") - 1))
    totals = cut(placed.groupBy("s", "block").agg(F.sum("size").alias("words"), F.first("whole").alias("whole"), F.first("rest").alias("rest")).withColumn("g", F.expr(f"block div {PREFIX}")))
    earlier = lambda w: F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = totals.groupBy("s", "g").agg(F.sum("words").alias("words")).select("s", "g", earlier(Window.partitionBy("s").orderBy("g")).alias("before"))
    blocks = totals.withColumn("start", earlier(Window.partitionBy("s", "g").orderBy("block"))).join(groups, ["s", "g"])
    blocks = cut(blocks.withColumn("start", F.col("start") + F.col("before")).drop("before", "g"))
    times = F.col("whole") + F.when(F.col("start") < F.col("rest"), 1).otherwise(0)
    draws = blocks.withColumn("times", times).where("times > 0").select("s", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("times") - 1)).alias("copy"))
    draws = cut(numbered(draws, seed))
    count = {r.s: r.n for r in draws.groupBy("s").agg(F.count("*").alias("n")).collect()}
    leaf = split_quotas(np.array([count.get(r[0], 0) for r in rows], np.int64), shards, seed)
    lists = dealt_blocks(draws, leaf).groupBy("s", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("drawn"))
    per_block = cut(blocks.select("s", "block", "start").join(lists, ["s", "block"], "left"))
    within = Window.partitionBy("s", "block").orderBy("u", "doc_id", "size")
    at = placed.withColumn("in_block", earlier_sizes(within)).withColumn("place_in_block", F.row_number().over(within)).join(per_block, ["s", "block"])
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("in_block")))
    copies = F.transform("drawn", lambda d: F.struct(d["copy"].alias("copy"), d["shard"].alias("shard"), F.when(d["copy"] < F.col("whole"), F.col("size")).otherwise(part).alias("words"), F.xxhash64(d["shard"], d["copy"], F.col("u"), F.lit(seed)).alias("place")))
    copies = F.filter(F.coalesce(copies, F.array().cast("array<struct<copy:bigint,shard:int,words:bigint,place:bigint>>")), lambda c: (c["words"] > 0) | (c["copy"] < F.col("whole")))
    return at.select("doc_id", "source", "size", "source_size", "target", "s", "block", "place_in_block", copies.alias("copies"), *(["row"] if with_row else []))


def earlier_sizes(within):
    return F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def in_shards(took: DataFrame, shards: int | None = None) -> DataFrame:
    """Rows of mix() with `c`, one of their copies, where the shards have them: a shard's rows together, in its own order."""
    return (took.repartition(shards, F.col("c.shard")) if shards else took.repartition(F.col("c.shard"))).sortWithinPartitions("c.shard", "c.place")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most: float = MOST, shards: int | None = None, seed: int = 17) -> DataFrame:
    """The mix itself: docs' rows as often as it takes them, by shard and in each shard's order.

    A row taken in part has its text cut after the last word taken; n_chars, where there is one, is the length of what is taken.
    """
    took = mix(docs, weights, most, shards, seed, with_row=True).select("row", "size", F.explode("copies").alias("c"))
    dealt = in_shards(took, shards)
    space = r"[\x20\x09-\x0D]"
    words = F.split(F.col("row.text"), rf"(?<=[^\x20\x09-\x0D])(?={space})", -1)
    text = F.when(F.col("c.words") < F.col("size"), F.array_join(F.slice(words, F.lit(1), F.col("c.words").cast("int")), "")).otherwise(F.col("row.text"))
    out = {n: F.col("row").getField(n) for n in docs.columns} | {"text": text}
    if "n_chars" in out:
        out["n_chars"] = F.when(text.isNull(), F.col("row.n_chars")).otherwise(F.length(text)).cast(dict(docs.dtypes)["n_chars"])
    return dealt.select(*(c.alias(n) for n, c in out.items()))


def taken(mixed: DataFrame) -> DataFrame:
    """The digest of mix(): of each document the words that its rows in the shards hold, repeats counted, and the shards, as often as they hold it."""
    key = ["s", "block", "place_in_block"]
    mixed = cut(mixed)
    rows = in_shards(mixed.select(*key, F.explode("copies").alias("c")))
    got = rows.groupBy(*key).agg(F.sum("c.words").alias("taken"), F.sort_array(F.collect_list("c.shard")).alias("shards"))
    return mixed.join(got, key, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))
