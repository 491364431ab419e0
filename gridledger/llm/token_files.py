"""Token ids as flat little-endian unsigned 32-bit files with 64-bit document offsets.

A data set is a folder of shards. Shard k holds documents whose ids come after those of shard k - 1:

* ids-<k>.u2 (or .u4): the ids of its documents, one after another, 2 bytes each where the vocabulary allows, else 4;
* off-<k>.bin: n + 1 signed 64-bit offsets, counted from the first id of the whole data set, so that document i of the
  shard is ids[off[i] - off[0] : off[i + 1] - off[0]];
* doc-<k>.bin: the n document ids, signed 64-bit (a null id is the least long, and sorts first).

<k> is the shard's number and a name of the attempt's own. Which attempt counts is what the finished job's rows say (write_tokens
gives them); files of attempts that were lost are deleted then. Nothing is renamed. Offsets need the number of ids in all earlier
shards: the base of a shard is the prefix sum of shard lengths. Documents stand in the order of their id, then of a hash of the
text, then of the text, so that every attempt writes the same. A null text is empty: its document holds the end id alone.
Repeated rows are written each. An empty table has no shards.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.llm.shared import cut, fresh_dir, ready

NULL_ID = -(1 << 63)
#: Chunks of a generation: a worker remembers the ids of those it met in the last one or two, across tasks.
REMEMBER = 400_000
#: A space with white space (or an end) on both sides; elsewhere, no token of the pattern crosses the place before a space.
_ODD_SPACE = r"[\s\v\x1c-\x1f\x{85}\pZ] (?:[\s\v\x1c-\x1f\x{85}\pZ]|\z)"


class ChunkEncoder:
    """Encodes texts with a byte-level BPE tokenizer, each distinct chunk once.

    The tokenizer's pattern never matches across a non-space character and the space after it, so a text's ids are those
    of its chunks " word" one after another. Texts where a space touches white space on both sides go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        size = self.model.get_vocab_size(with_added_tokens=True)
        self.dtype = "<u2" if size <= 1 << 16 else "<u4"
        self.starts = np.array([(self.model.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, fresh: set[str]) -> None:
        """Encodes new chunks: those without white space at their ends as one long text, which parts where an id starts with a space."""
        young, old = self.young, self.old
        again = old.keys() & fresh
        young.update(zip(again, map(old.__getitem__, again)))
        fresh = fresh - again
        # A chunk without white space at its ends is what strip() leaves of it; the empty chunk goes with the others.
        plain = [w for w in fresh if w and w.strip() == w]
        other = [w for w in fresh if not w or w.strip() != w]
        for i in range(0, len(plain), 5000):
            part = plain[i : i + 5000]
            ids = np.array(self.model.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            at = np.flatnonzero(self.starts[ids])
            if len(at) != len(part) or at[0]:
                raise AssertionError("a chunk's ids hold a space of their own")
            raw, cuts = ids.tobytes(), [*(at * ids.itemsize).tolist(), len(ids) * ids.itemsize]
            young.update(zip(part, [raw[s:e] for s, e in zip(cuts, cuts[1:])]))
        for w, e in zip(other, self.model.encode_batch_fast([w[1:] if w[:1] == " " else " " + w for w in other], add_special_tokens=False)):
            young[w] = np.array(e.ids, self.dtype).tobytes()

    def encode_column(self, texts, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow column of texts (null: empty), each followed by the ids in end, one after another, and how many each text has.

        Arrow splits the texts and numbers their distinct chunks, so that a chunk is looked up once a column; numpy puts the ids together.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, _ODD_SPACE)
        split = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        numbered = split.flatten().dictionary_encode()
        first, at = np.asarray(split.offsets)[:-1] - split.offsets[0].as_py(), np.array(numbered.indices)
        # A chunk is known by its word, which holds no space; the first one, which no space precedes, by a space and its word.
        words = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        firsts = [" " + words[i] for i in at[first]]
        if len(self.young) > REMEMBER:
            self.old, self.young = self.young, {}
        self.learn({*words, *firsts}.difference(self.young))
        known = [*map(self.young.__getitem__, words), *map(self.young.__getitem__, firsts)]
        at[first] = np.arange(len(words), len(known))
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            ids = self.model.encode(texts[i].as_py(), add_special_tokens=False).ids
            known[at[first[i]]] = np.array(ids, self.dtype).tobytes()
        at = np.insert(at, np.r_[first[1:], len(at)], len(known))
        known.append(end)
        ids, width = np.frombuffer(b"".join(known), self.dtype), np.dtype(self.dtype).itemsize
        size = np.fromiter(map(len, known), np.int64, len(known)) // width
        begin, taken = (np.cumsum(size) - size)[at], size[at]
        ends = np.cumsum(taken)
        place = np.arange(ends[-1])
        place += np.repeat(begin - (ends - taken), taken)
        return ids[place], np.diff(ends[np.r_[first[1:], len(at) - len(first)] + np.arange(len(first))], prepend=0)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned integers of dtype."""
        import pyarrow as pa

        if not texts:
            return []
        ids, lengths = self.encode_column(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(lengths)[:-1])]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder_of(path: str) -> ChunkEncoder:
    """This process's encoder for a tokenizer file; it outlives tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def filesystem(uri: str):
    """(Arrow file system, path) of a folder's address; a bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), re.sub("^file:/*", "/", uri))


def put(where, path: str, parts) -> None:
    with where.open_output_stream(path) as f:
        for x in parts:
            f.write(x)


def get(where, path: str, dtype: str) -> np.ndarray:
    """A file's numbers: memory-mapped on a local or mounted file system, else read."""
    if where.type_name == "local":
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    with where.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Writes docs (doc_id, text) under folder in ascending doc_id order; gives (shard, name, docs, ids, base) of each shard.

    Documents are range-partitioned by doc_id, then encoded where they land, so that only texts are shuffled, once.
    """
    spark = ready(docs.sparkSession)
    from pyarrow import fs

    where, root = filesystem(folder)
    where.create_dir(root, recursive=True)

    def write(batches):
        import pyarrow as pa

        where, root = filesystem(folder)
        shard, encoder = TaskContext.get().partitionId(), encoder_of(tokenizer_path)
        k, lengths, own = f"{shard}-{uuid.uuid4().hex}", [], []
        ids = f"{root}/ids-{k}.{encoder.dtype[1:]}"
        end = np.array([end_id], encoder.dtype).tobytes()
        with where.open_output_stream(ids) as f:
            for b in batches:
                for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                    own.append(part.column("doc_id").to_numpy(zero_copy_only=False).astype("<i8"))
                    out, many = encoder.encode_column(part.column("text"), end)
                    f.write(out.tobytes())
                    lengths.append(many)
        lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        if not len(lengths):
            where.delete_file(ids)
            return
        put(where, f"{root}/doc-{k}.bin", [x.tobytes() for x in own])
        put(where, f"{root}/len-{k}.bin", [lengths.astype("<i8").tobytes()])
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": [k], "docs": pa.array([len(lengths)], pa.int64()), "ids": pa.array([int(lengths.sum())], pa.int64())})

    src = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    ranged = src.repartitionByRange(shards, "doc_id", "h") if shards else src.repartitionByRange("doc_id", "h")
    done = cut(ranged.sortWithinPartitions("doc_id", "h", "text").drop("h").mapInArrow(write, "shard int, name string, docs bigint, ids bigint"))
    # One row for each shard: their prefix sum is the driver's.
    base, rows = 0, []
    for r in sorted(done.collect()):
        rows.append((*r, base))
        base += r.ids
    kind = "shard int, name string, docs bigint, ids bigint, base bigint"
    bases, counted = spark.createDataFrame(rows, kind), {r[1] for r in rows}
    for f in where.get_file_info(fs.FileSelector(root)):
        if re.sub(r"^[a-z]+-|\.\w+$", "", f.base_name) not in counted:
            where.delete_file(f.path)

    def offsets(batches):
        import pyarrow as pa

        where, root = filesystem(folder)
        for b in batches:
            for k, first in zip(b.column("name").to_pylist(), b.column("base").to_pylist()):
                # Any attempt writes the same bytes.
                put(where, f"{root}/off-{k}.bin", [np.r_[first, first + np.cumsum(get(where, f"{root}/len-{k}.bin", "<i8"))].astype("<i8").tobytes()])
            yield pa.RecordBatch.from_arrays([b.column(n) for n in ("shard", "name", "docs", "ids", "base")], names=["shard", "name", "docs", "ids", "base"])

    return cut(bases.repartition(max(1, len(rows))).mapInArrow(offsets, kind))


def read_tokens(written: DataFrame, folder: str, dtype: str = "<u2") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; one shard is mapped at a time."""

    def read(batches):
        import pyarrow as pa

        where, root = filesystem(folder)
        for b in batches:
            for k in b.column("name").to_pylist():
                ids, off, doc = (get(where, f"{root}/{x}", d) for x, d in ((f"ids-{k}.{dtype[1:]}", dtype), (f"off-{k}.bin", "<i8"), (f"doc-{k}.bin", "<i8")))
                for i in range(0, len(doc), 10_000):
                    at = np.asarray(off[i : i + 10_001])
                    crc = [zlib.crc32(np.asarray(ids[s:e], "<u4")) for s, e in zip((at[:-1] - off[0]).tolist(), (at[1:] - off[0]).tolist())]
                    own = np.asarray(doc[i : i + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NULL_ID), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return written.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Writes docs in the file format to a new folder in the shared one, and reads every document back."""
    folder = fresh_dir(ready(docs.sparkSession), "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer_path, end_id, shards), folder, encoder_of(tokenizer_path).dtype)
