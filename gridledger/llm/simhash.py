"""SimHash near-duplicate detection by pigeonhole blocks.

Texts: ASCII-lower-cased words, 3-word shingles with repeats (fewer words: the whole sequence; none: fingerprint 0).
A null text is empty. A null doc_id is carried; a group of rows without any doc_id has a null component.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.llm.shared import as_bytes, components, cut, forest, ready, release, set_aside

#: Rows of a block key that one task compares with each other; larger keys are split into pairs of such chunks.
CHUNK = 512


def fingerprint_batch(texts: list[bytes], width: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text: a bit is set if it is set in over half the shingle hashes."""
    from xxhash import xxh64_digest

    out = np.zeros(len(texts), np.uint64)
    digests, ends, at = [], [], []

    def flush() -> None:
        raw = np.frombuffer(b"".join(digests), np.uint8)
        starts = np.array([0, *ends[:-1]])
        n = np.diff([0, *ends])
        # Counts of set bits per text; the digest is big-endian, so bit 63 comes first.
        ones = np.add.reduceat(np.unpackbits(raw.reshape(-1, 8), axis=1), starts, axis=0, dtype=np.uint32)
        out[at] = np.packbits(2 * ones > n[:, None], axis=1).view(">u8").ravel()
        digests.clear(), ends.clear(), at.clear()

    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        if len(words) <= width:
            digests.append(xxh64_digest(b" ".join(words), seed))
        else:
            digests.extend([xxh64_digest(b"%b %b %b" % w, seed) for w in zip(words, words[1:], words[2:])] if width == 3 else [xxh64_digest(b" ".join(words[j : j + width]), seed) for j in range(len(words) - width + 1)])
        ends.append(len(digests))
        at.append(i)
        if len(digests) > 50_000:
            flush()
    if digests:
        flush()
    return out


def fingerprints(docs: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' columns in keep (default: the id) and fp, the fingerprint as a signed long."""
    keep = [id_col] if keep is None else keep
    cols = list(dict.fromkeys([*keep, text_col]))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                fp = fingerprint_batch(as_bytes(part.column(text_col)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(fp.view(np.int64))], names=[*keep, "fp"])
        release()

    src = docs.select(*cols)
    return src.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name in keep) + ", fp bigint")


def plan_blocks(n: int, bits: int = 3, most: float = 4.0) -> tuple[int, int]:
    """(blocks, blocks of a key): the fewest keys at which random fingerprints meet fewer than `most` others. Every choice finds all pairs."""
    for blocks in range(bits + 2, bits + 7):
        used = blocks - bits
        keys = len(list(combinations(range(blocks), used)))
        if keys * n / 2.0 ** (64 * used / blocks) <= most:
            break
    return blocks, used


def block_keys(fp, blocks: int, used: int):
    """One long for each choice of `used` blocks: its number and its bits. Fingerprints that differ in at most blocks - used bits share one."""
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), used)):
        mask = sum(((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in chosen)
        keys.append(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))))
    return F.array(*keys)


def compare_groups(batches, bits: int):
    """Rows (key, i, j, fp) sorted by group come in; links within groups go out as forest edges. A group is split over batches at will."""
    import pyarrow as pa

    names, rest = ("key", "i", "j", "fp"), None

    def links(cols):
        key, i, j, fp = cols
        new = np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
        gid, u = np.cumsum(new), fp.view(np.uint64)
        idx, d, got = np.arange(len(fp)), 1, []
        while len(idx := idx[idx + d < len(fp)]) and len(idx := idx[gid[idx + d] == gid[idx]]):
            near = idx[np.bitwise_count(u[idx] ^ u[idx + d]) <= bits]
            if len(near):
                got.append((fp[near], fp[near + d]))
            d += 1
        if got:
            a, b = forest(np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got]))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        if rest is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(rest, cols)]
        if not len(cols[0]):
            continue
        last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
        first = len(last) - int(last[::-1].argmin()) if not last.all() else 0
        rest = [c[first:] for c in cols]
        yield from links([c[:first] for c in cols]) if first else ()
    if rest is not None and len(rest[0]):
        yield from links(rest)


def link_edges(fps: DataFrame, bits: int = 3, blocks: tuple[int, int] | None = None) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints fp differing in at most `bits` bits.

    Pigeonhole: with `blocks` blocks, two such fingerprints agree on at least blocks - bits of them. Only keys that two
    or more share go on; a key with more than CHUNK fingerprints is dealt into pairs of chunks, each a group of its own.
    """
    n, used = blocks or plan_blocks(fps.count(), bits)
    keyed = fps.select("fp", F.explode(block_keys(F.col("fp"), n, used)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = keyed.join(shared, "key").withColumn("of", F.ceil(F.col("n") / CHUNK).cast("int")).withColumn("c", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("of")).cast("int"))
    pairs = dealt.select("key", "fp", "c", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("o")).select("key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "fp")
    grouped = pairs.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return grouped.mapInArrow(lambda it: compare_groups(it, bits), "a bigint, b bigint")


def labelled(docfp: DataFrame, bits: int = 3, id_col: str = "doc_id") -> DataFrame:
    """(fp, root, component_id) for every distinct fingerprint of docfp (doc_id, fp), which must be cheap to read twice; root: the component's least fingerprint."""
    reps = cut(docfp.groupBy("fp").agg(F.min(id_col).alias("rep")))
    roots = cut(components(link_edges(reps.select("fp"), bits)))
    linked = roots.withColumnRenamed("node", "fp").join(reps, "fp")
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    moved = roots.join(least, "root").select(F.col("node").alias("fp"), "root", "component_id", F.lit(True).alias("moved"))
    both = reps.join(moved, "fp", "left")
    return cut(both.select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("moved"), F.col("component_id")).otherwise(F.col("rep")).alias("component_id")))


def simhash_components(docs: DataFrame, bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links of at most `bits` bits) for every row."""
    ready(docs.sparkSession)
    docfp = cut(fingerprints(docs))
    return docfp.join(labelled(docfp, bits), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, bits: int = 3) -> DataFrame:
    """docs with one row of each component: of the rows of its least doc_id, that of the least hash. Columns of any name pass.

    Fingerprints are computed once, and groups meet as numbers. A text is shuffled once, by a hash of its whole row, so that
    a group of copies, however large, is dealt over all tasks.
    """
    ready(docs.sparkSession)
    rows, aside = set_aside(docs, ["doc_id", "text"])
    hashable = [f.name for f in rows.schema if "map<" not in f.dataType.simpleString()]
    rows = rows.withColumn("__h1", F.xxhash64(*hashable)).withColumn("__h2", F.xxhash64(F.lit(1), *hashable))
    docfp = cut(fingerprints(rows, keep=["doc_id", "__h1", "__h2"]))
    label = labelled(docfp.select("doc_id", "fp"), bits)
    first = docfp.join(label, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("__h1", "__h2")).alias("h"))
    kept = rows.join(first.select("h.__h1", "h.__h2").distinct(), ["__h1", "__h2"], "left_semi").dropDuplicates(["__h1", "__h2"])
    return kept.withColumnsRenamed(aside).select(*docs.columns)
