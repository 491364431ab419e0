"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Two multinomials over hashed words and word pairs are counted: one over every document (raw), one over the documents that
a table of labels marks as good (target). A document's score is the mean, over its n-grams, of log p_target / p_raw, so
length does not matter. A document is kept if no base rule fails and its score reaches a fixed threshold; the same rows
give the same verdicts in every run. Words are [^\\x20\\x09-\\x0D]+ of the whole text. A null or empty text has no words,
score 0 and fails the base rule. Repeated rows are scored each; a doc_id with any good label is target.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.llm.shared import as_bytes, ready

#: Buckets of words and of word pairs, each.
BUCKETS = 1 << 14
THRESHOLD = -0.1
SMOOTH = 1.0
SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\v\f\r"


def buckets(words: list[bytes]) -> np.ndarray:
    """Bucket of each word, then of each pair of neighbours. Trailing punctuation is part of a word."""
    h = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    pair = (h[:-1] * np.uint32(0x9E3779B1)) ^ (h[1:] + np.uint32(0x7F4A7C15))
    pair ^= pair >> np.uint32(15)
    return np.concatenate([h % BUCKETS, pair % BUCKETS + BUCKETS]).astype(np.int64)


def base_rules(text: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    bare = text.translate(None, _SPACES)
    chars = len(bare.decode())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(_SPACES):
            seen.add(line)
    n, repeat = len(words), 0
    if n > 2:
        number: dict[bytes, int] = {}
        ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, n)
        v = len(number)
        codes = ids[:-2] * v + ids[1:-1]
        if v > 2_000_000:  # three ids would overflow: number the pairs first
            codes = np.unique(codes, return_inverse=True)[1]
        codes = codes * v + ids[2:]
        _, inv, count = np.unique(codes, return_inverse=True, return_counts=True)
        many = count[inv] > 1
        if many.any():
            mark = np.zeros(n, bool)
            mark[:-2] |= many
            mark[1:-1] |= many
            mark[2:] |= many
            repeat = int(mark.sum())
    return chars, symbols, dup, repeat


def count_ngrams(docs: DataFrame, good: DataFrame) -> np.ndarray:
    """[2, 2 * BUCKETS]: n-grams of the raw corpus and of the target. Each task sends one row for each bucket it met."""
    ids = good.select(F.col("doc_id").alias("good_id")).where("good_id is not null").distinct()
    # By merge at every size: the labels grow with the corpus, and texts are shuffled once.
    marked = docs.select("doc_id", "text").join(ids.hint("merge"), F.col("doc_id") == F.col("good_id"), "left").select("text", F.col("good_id").isNotNull().alias("good"))

    def run(batches):
        import pyarrow as pa

        total = np.zeros((2, 2 * BUCKETS), np.int64)
        for b in batches:
            for text, good in zip(as_bytes(b.column("text")), b.column("good").to_pylist()):
                if words := text.split():
                    got = np.bincount(buckets(words), minlength=2 * BUCKETS) if len(words) > 3000 else buckets(words)
                    for k in (0, 1) if good else (0,):
                        if len(words) > 3000:
                            total[k] += got
                        else:
                            np.add.at(total[k], got, 1)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], names=["bucket", "raw", "good"])

    sums = marked.mapInArrow(run, "bucket bigint, raw bigint, good bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    out = np.zeros((2, 2 * BUCKETS), np.int64)
    for r in sums.collect():  # at most 2 * BUCKETS rows
        out[:, r.bucket] = r.raw, r.good
    return out


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """log p_target / p_raw of every bucket, add-SMOOTH, words and pairs each a multinomial of their own."""
    c = counts.reshape(2, 2, BUCKETS) + SMOOTH
    p = np.log(c / c.sum(2, keepdims=True))
    return (p[1] - p[0]).ravel()


def judge(docs: DataFrame, good: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score of every row of docs."""
    spark = ready(docs.sparkSession)
    ratio = spark.sparkContext.broadcast(log_ratio(count_ngrams(docs, good)))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        import pyarrow as pa

        table = ratio.value
        for b in batches:
            for part in (b.slice(i, 2000) for i in range(0, b.num_rows, 2000)):
                rows, scores = [], []
                for text in as_bytes(part.column("text")):
                    words = text.split()
                    rows.append((len(words), *base_rules(text, words)))
                    scores.append(float(table[buckets(words)].mean()) if words else 0.0)
                n = np.array(rows, np.int64).reshape(-1, 5)
                score = np.array(scores)
                failed = (n[:, 0] < 50) | (100 * n[:, 4] > 50 * n[:, 0])
                cols = [part.column("doc_id"), *(pa.array(n[:, i]) for i in range(5)), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *names, "base_failed", "kept", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names) + ", base_failed boolean, kept boolean, score double")
