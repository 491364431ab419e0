"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two words sums over their common subsequences of three characters, each weighing LAMBDA to the power of the
lengths it spans in both, normalised: letters that are inserted, masked or left out lower it, but do not end it. A word is
mapped to its kernels with a few landmark words times the inverse square root of the landmarks' own kernel matrix; a linear
support vector machine on that map gives the word's margin. A document is judged by the two largest of its words' margins; runs of
single characters ("i d i o t") count as words too, and words over LONG characters are read in overlapping windows. A
logistic curve, fitted to labelled documents, turns them into the score.

Labels mark documents, not words. Words of labelled sentences that occur in more toxic documents, against clean ones, than chance gives are
the first positive examples; then, for each toxic document without any, its word of the largest margin joins them, and the
machine is trained again, on these words and on forms of them with signs put in or in place of characters. Documents count as one
where the word stands between the same two words, as it does in copies. The curve is fitted to the fold of the sample that the
machine did not learn from. All words of all
documents of the sample are looked through in each of ROUNDS rounds, in tasks: those of toxic documents for the best, all
clean words for the HARDEST that look toxic, which join the negative examples. Training uses a
sample of at most `most` toxic and CLEAN times as many clean labelled documents, those of the least hash of doc_id; every
document is scored.

Null and empty texts have the margin of a word unlike any landmark. Rows whose doc_id is null are held out of training, as
are labels that are null or that contradict each other. Without labels of both kinds every score is 0. Repeated rows are scored each.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.llm.shared import as_bytes, crc32_text, cut, ready, release

LAMBDA = np.float32(0.6)
LANDMARKS = 160
LONG = 24
#: One fold of so many of the sample fits the logistic curve and nothing else.
FOLDS = 5
#: Toxic documents of the training sample at most; of clean ones, CLEAN times as many.
MOST_LABELS, CLEAN = 1500, 4
#: Rounds of training; clean words that join the negatives in a round at most, and the margin that they have at least.
ROUNDS, HARDEST, NEAR = 4, 500, -0.8
#: Kernel with a clean look-alike from which on a toxic word is not learned in disguise.
ALIKE = 0.6
#: Margin that the best word of an unexplained toxic document has at least.
SURE = 0.5
#: Negatives of the first round: the most frequent clean words, and of those behind every RARE_STEP-th up to RARE.
COMMON, RARE_STEP, RARE = 3000, 7, 1500
#: Landmarks that are clean words, and the negatives of the largest margin that they are chosen of.
CLEAN_LANDMARKS, CLEAN_CHOICE = 64, 400
#: Positives of the first round where no word is in enough toxic documents.
FEW = 10
REMEMBER = 100_000
_RUNS = re.compile(r"(?<!\S)(?:\S\s){2,}\S(?!\S)")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """[longest, words] code points, 0 beyond a word's end, and lengths."""
    n = np.array([len(w) for w in words])
    out = np.zeros((len(words), max(1, n.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1])[None] < n[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return out.T.copy(), n


def self_kernel(words: list[str]) -> np.ndarray:
    """The kernel of each word with itself."""
    c, n = _codes(words)
    return _dp(c, n, np.where(c == 0, np.uint32(0xFFFFFFFF), c)[:, :, None])[:, 0]


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """[words, landmarks] of unnormalised subsequence kernels."""
    c, n = _codes(words)
    t, _ = _codes(landmarks)
    return _dp(c, n, np.where(t == 0, np.uint32(0xFFFFFFFF), t)[:, None, :])


def _dp(c: np.ndarray, n: np.ndarray, t: np.ndarray) -> np.ndarray:
    """c: [length, words]; t: [length, words or 1, others]. All pairs go through the recurrence together; longer words come last."""
    order = np.argsort(-n, kind="stable")
    c = c[:, order]
    width, m = len(t), t.shape[2]
    if t.shape[1] > 1:
        t = t[:, order]
    k = np.zeros((c.shape[1], m), np.float32)
    one, two = (np.zeros((width, c.shape[1], m), np.float32) for _ in range(2))
    lengths, sq = n[order], LAMBDA * LAMBDA
    for a in range(len(c)):
        live = int((lengths > a).sum())
        if not live:
            break
        x = c[a, :live, None]
        r1, r2 = np.zeros((live, m), np.float32), np.zeros((live, m), np.float32)
        for j in range(width):
            hit = (x == t[j, : live if t.shape[1] > 1 else 1]) * sq
            o, w = one[j, :live], two[j, :live]
            k[:live] += hit * w
            w2, o2 = LAMBDA * w + r2, LAMBDA * o + r1
            r2 = LAMBDA * r2 + hit * o
            r1 = LAMBDA * r1 + hit
            two[j, :live], one[j, :live] = w2, o2
    out = np.empty_like(k)
    out[order] = k
    return out


def normalised(words: list[str], landmarks: list[str], own: np.ndarray) -> np.ndarray:
    """Kernels between 0 and 1; own: the landmarks' kernels with themselves."""
    k = kernel(words, landmarks) / np.sqrt(np.maximum(self_kernel(words), 1e-12))[:, None] / np.sqrt(own)[None]
    return np.where(np.array([len(w) for w in words])[:, None] < 3, 0, k)


def table_of(landmarks: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The landmarks' weighted sum as one weight for each three characters: sorted code points, and a cube over their places (0: any other)."""
    known = np.unique(np.frombuffer("".join(landmarks).encode("utf-32-le"), np.uint32))
    cube = np.zeros((len(known) + 1,) * 3)
    for word, weight in zip(landmarks, weights):
        c = np.searchsorted(known, np.frombuffer(word.encode("utf-32-le"), np.uint32)) + 1
        for i, j, k in combinations(range(len(c)), 3):
            cube[c[i], c[j], c[k]] += weight * float(LAMBDA) ** (k - i + 1)
    return known, cube


@dataclass
class Machine:
    """Weights on the landmarks' kernels (the Nystroem map folded in), and the logistic curve.

    The kernel is a product of vectors over all three-character subsequences, so the weighted sum of a word's kernels with
    the landmarks is the product of the word's vector with that of the landmarks' sum, whatever their number.
    """

    landmarks: list[str]
    own: np.ndarray
    alpha: np.ndarray
    bias: float
    slope: tuple[float, float] = (1.0, 0.0)
    shift: float = 0.0

    def __post_init__(self):
        self.known, self.cube = table_of(self.landmarks, self.alpha / np.sqrt(np.maximum(self.own, 1e-12)))

    def margins(self, words: list[str]) -> np.ndarray:
        """Of words of at most LONG characters, as plain() gives them."""
        out = np.full(len(words), self.bias)
        if not self.landmarks or not words:
            return out
        lengths = np.array([len(w) for w in words])
        order = np.argsort(lengths, kind="stable")
        ends = np.searchsorted(lengths[order], np.arange(LONG + 2))
        for n in range(3, LONG + 1):
            for i in range(ends[n], ends[n + 1], 4096):
                at = order[i : min(i + 4096, ends[n + 1])]
                own = [words[j] for j in at]
                c = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(-1, n)
                place = np.searchsorted(self.known, c)
                place = np.where(self.known[np.minimum(place, len(self.known) - 1)] == c, place + 1, 0)
                out[at] += self._products(np.ascontiguousarray(place.T)) / np.sqrt(np.maximum(self_kernel(own), 1e-12))
        return out

    def _products(self, c: np.ndarray) -> np.ndarray:
        """c: [length, words] places. By the middle and last characters, the sums over the first fall with their distance."""
        size = len(self.cube)
        flat, total = self.cube.ravel(), np.zeros(c.shape[1])
        for i, j in combinations(range(len(c) - 1), 2):
            if c[i].any() and c[j].any():
                pair = (c[i] * size + c[j]) * size
                for k in range(j + 1, len(c)):
                    total += flat[pair + c[k]] * float(LAMBDA) ** (k - i + 1)
        return total


def plain(token: str) -> list[str]:
    """The words that a token is scored as: lower case, no punctuation at its ends, windows of LONG characters."""
    w = _EDGES.sub("", token.lower())
    return [w] if len(w) <= LONG else [w[i : i + LONG] for i in range(0, len(w) - LONG // 2, LONG // 2)]


def words_of(text: str) -> set[str]:
    tokens = set(text.split())
    for run in _RUNS.findall(text):
        tokens.add("".join(run.split()))
    return tokens


def contexts_of(text: str) -> dict[str, int]:
    """Of every word that the text is scored by, the least hash of the words on both sides. Copies of a passage share it; words written anew do not."""
    out: dict[str, int] = {}

    def add(token: str, around: str) -> None:
        at = zlib.crc32(around.encode())
        for w in plain(token):
            if len(w) >= 3:
                out[w] = min(out.get(w, at), at)

    tokens = ["", *text.split(), ""]
    for before, token, after in zip(tokens, tokens[1:], tokens[2:]):
        add(token, f"{before} {after}")
    for run in _RUNS.finditer(text):
        add("".join(run.group().split()), text[max(0, run.start() - 20) : run.start()])
    return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1e-5) -> np.ndarray:
    """Weights (bias last) of a linear machine with squared hinge loss, by Newton steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    ridge = reg * weight.sum() * np.diag([1.0] * x.shape[1] + [1e-3])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        on = y * (z @ w) < 1
        zc = z[on] * weight[on, None]
        new = np.linalg.solve(ridge + zc.T @ z[on], zc.T @ y[on])
        if np.allclose(new, w, atol=1e-7):
            break
        w = 0.5 * w + 0.5 * new
    return w


def disguised(word: str) -> list[str]:
    """The word with a sign put between two characters, in place of an inner one, or between all of them."""
    put = [word[:i] + "*" + word[i:] for i in range(1, len(word))]
    mask = [word[:i] + "*" + word[i + 1 :] for i in range(1, len(word) - 1)]
    return [w for w in dict.fromkeys([*put, *mask, "*".join(word)]) if len(w) <= LONG]


def choose(words: list[str], count: int) -> list[str]:
    """Landmarks by pivoted Cholesky: the next is the word that those before explain least; ties go to the first."""
    words = [w for w in words if len(w) >= 3]
    if not words:
        return []
    own = self_kernel(words)
    left, rows, out = np.ones(len(words)), [], []
    for _ in range(min(count, len(words))):
        i = int(left.argmax())
        if left[i] < 1e-4:
            break
        k = normalised(words, [words[i]], own[[i]])[:, 0]
        for r in rows:
            k = k - r * r[i]
        rows.append(k / np.sqrt(left[i]))
        left = np.maximum(0, left - rows[-1] ** 2)
        out.append(words[i])
    return out


def train(seeds: list[str], good: list[tuple[str, int]], best, hardest) -> Machine:
    """seeds: the first positives; good: the first negatives, with their numbers of clean documents. best(machine, positives):
    the best words of toxic documents without a positive; hardest(machine, negatives): clean words, with their numbers, that look toxic."""
    often, near = dict(good), set()
    negative, positive = list(often), list(seeds)
    machine = Machine([], np.zeros(0), np.zeros(0), -1.0)
    for _ in range(ROUNDS):
        marks = choose(positive, LANDMARKS - CLEAN_LANDMARKS)
        if not marks:
            return machine
        scores = machine.margins(negative)
        hard = [negative[i] for i in np.argsort(-scores, kind="stable")[:CLEAN_CHOICE]]
        marks += [w for w in choose(hard, CLEAN_LANDMARKS) if w not in marks]
        own = self_kernel(marks)
        mm = normalised(marks, marks, own)
        value, vector = np.linalg.eigh((mm + mm.T) / 2)
        root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-4))) @ vector.T
        # Words that clean ones resemble are learned as they stand; the others in disguise too, once it is known which those are.
        looks = normalised(sorted(near), positive, self_kernel(positive)).max(0) if near else np.ones(len(positive))
        dressed = {w: disguised(w) for w, x in zip(positive, looks) if x < ALIKE}
        forms = [x for own in dressed.values() for x in own]
        share = [1 / len(own) for own in dressed.values() for _ in own]
        words = positive + forms + negative
        kx = np.vstack([normalised(words[i : i + 512], marks, own) for i in range(0, len(words), 512)])
        y = np.array([1.0] * (len(positive) + len(forms)) + [-1.0] * len(negative))
        # Toxic words and their disguises, clean ones that look toxic, and the other clean ones weigh the same; common clean words weigh more.
        side = np.array([0] * (len(positive) + len(forms)) + [1 if x in near else 2 for x in negative])
        of = np.array([1.0] * len(positive) + share + [often[x] if x in near else math.sqrt(often[x]) for x in negative])
        weight = of / np.maximum(np.bincount(side, of, 3), 1e-9)[side] * len(y) / 3
        w = svm(kx @ root, y, weight)
        machine = Machine(marks, own, root @ w[:-1], float(w[-1]))
        # Clean words that look toxic join the negatives; the best word of unexplained toxic documents joins the positives.
        more = hardest(machine, negative)
        often.update(more)
        near.update(x for x, _ in more)
        negative = list(dict.fromkeys(negative + [x for x, _ in more]))
        positive = list(dict.fromkeys(positive + best(machine, positive)))
    return machine


def lone_words(seen: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc, words): of every toxic document of the sample, all its words that are in more toxic than clean ones."""
    return seen.where("toxic = 1").join(counts.where("t > c").select("word"), "word").groupBy("doc").agg(F.sort_array(F.collect_list("word")).alias("words"))


def best_words(lone: DataFrame, machine: Machine, positive: list[str]) -> list[str]:
    """The word of the largest margin of each document that holds no positive, if it is SURE; one row a document comes here."""
    known = lone.sparkSession.sparkContext.broadcast((machine, frozenset(positive)))

    def run(batches):
        import pyarrow as pa

        m, have = known.value
        for b in batches:
            out = ([], [])
            for doc, own in zip(b.column("doc").to_pylist(), b.column("words").to_pylist()):
                if have.isdisjoint(own):
                    got = m.margins(own)
                    if got.max() > SURE:
                        out[0].append(doc), out[1].append(own[int(got.argmax())])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())], names=["doc", "word"])

    return [r.word for r in sorted(lone.mapInArrow(run, "doc bigint, word string").collect())]


def hardest_words(clean: DataFrame, machine: Machine, negative: list[str]) -> list[tuple[str, int]]:
    """Of all clean words (word, c) that are no negatives yet, the HARDEST of the largest margins over NEAR."""
    known = clean.sparkSession.sparkContext.broadcast((machine, frozenset(negative)))

    def run(batches):
        import pyarrow as pa

        m, have = known.value
        for b in batches:
            rows = [(w, c) for w, c in zip(b.column("word").to_pylist(), b.column("c").to_pylist()) if w not in have]
            got = m.margins([w for w, _ in rows])
            near = [(w, c, x) for (w, c), x in zip(rows, got.tolist()) if x > NEAR]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in near], pa.string()), pa.array([r[1] for r in near], pa.int64()), pa.array([r[2] for r in near], pa.float64())], names=["word", "c", "margin"])

    top = clean.mapInArrow(run, "word string, c bigint, margin double").orderBy(F.desc("margin"), F.desc("c"), F.xxhash64("word"), "word").limit(HARDEST)
    return [(r.word, r.c) for r in top.collect()]


def curve(machine: Machine, margins: np.ndarray) -> np.ndarray:
    """The score of documents' two largest margins."""
    return 1 / (1 + np.exp(-np.clip(np.clip(margins, -1, 3) @ np.array(machine.slope) + machine.shift, -700, 700)))


def calibrate(machine: Machine, margins: np.ndarray, toxic: np.ndarray) -> None:
    """Fits the logistic curve of the two largest margins by Newton steps; targets are smoothed by class counts. It never falls with a margin."""
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    t = np.where(toxic == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for used in (2, 1):
        z = np.hstack([np.clip(margins[:, :used], -1, 3), np.ones((len(margins), 1))])
        w = np.zeros(used + 1)
        for _ in range(60):
            p = 1 / (1 + np.exp(-z @ w))
            h = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(used + 1)
            w = w + np.clip(np.linalg.solve(h, z.T @ (t - p) - 1e-3 * w), -2, 2)
        if (w[:-1] >= 0).all() and w[0] > 0:
            machine.slope, machine.shift = (float(w[0]), float(w[1]) if used > 1 else 0.0), float(w[-1])
            return


_MEMORY: dict = {}


def document_margins(machine: Machine, key: str, texts: list[str]) -> np.ndarray:
    """The largest and second largest margin among each text's words. The worker remembers words' margins through a task, two generations of REMEMBER."""
    if _MEMORY.get("key") != key:
        _MEMORY.update(key=key, young={}, old={})
    if len(_MEMORY["young"]) > REMEMBER:
        _MEMORY.update(old=_MEMORY["young"], young={})
    young, old = _MEMORY["young"], _MEMORY["old"]
    rows, fresh = [], set()
    for t in texts:
        rows.append(words_of(t))
        fresh.update(w for w in rows[-1] if w not in young)
    todo: dict[str, list[str]] = {}
    for w in fresh:
        if w in old:
            young[w] = old[w]
        else:
            todo[w] = plain(w)
    parts = list({p for x in todo.values() for p in x if len(p) >= 3})
    margin = dict(zip(parts, machine.margins(parts).tolist()))
    for w, x in todo.items():
        young[w] = max((margin.get(p, machine.bias) for p in x), default=machine.bias)
    out = np.full((len(rows), 2), machine.bias)
    for i, r in enumerate(rows):
        got = heapq.nlargest(2, map(young.__getitem__, r)) if len(r) > 1 else list(map(young.__getitem__, r)) * 2
        if got:
            out[i] = got[0], min(got[1], got[0])
    return out


def labelled_sample(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, toxic) of training rows: crc32 of the id mod 4 is not 2, one label for each id, at most `most` of either kind."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("top"))
    one = one.where((F.col("toxic") == F.col("top")) & (crc32_text(F.col("doc_id")) % 4 != 2)).select("doc_id", "toxic")
    kind = lambda k, n: one.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    return kind(1, most).unionByName(kind(0, CLEAN * most))


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> Machine:
    spark = docs.sparkSession
    rows = [(r.doc_id, int(r.toxic)) for r in labelled_sample(labels, most).collect()]  # at most (1 + CLEAN) * most
    silent = Machine([], np.zeros(0), np.zeros(0), -1.0, slope=(0.0, 0.0), shift=-40.0)
    if len({t for _, t in rows}) < 2:
        return silent
    kind = dict(docs.dtypes)["doc_id"]
    folded = spark.createDataFrame(rows, f"doc_id {kind}, toxic int").withColumn("apart", F.pmod(F.xxhash64("doc_id", F.lit(FOLDS)), F.lit(FOLDS)) == 0)
    sample = docs.select("doc_id", "text").join(F.broadcast(folded), "doc_id")

    def words(batches):
        import pyarrow as pa

        for b in batches:
            out = ([], [], [], [])
            for text, toxic in zip(as_bytes(b.column("text")), b.column("toxic").to_pylist()):
                own = contexts_of(text.decode())
                doc = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)
                out[0].extend(own), out[1].extend([toxic] * len(own)), out[2].extend([doc] * len(own)), out[3].extend(own.values())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names=["word", "toxic", "doc", "context"])

    # Of one word there are at most (1 + CLEAN) * most rows.
    seen = cut(sample.where("not apart").mapInArrow(words, "word string, toxic int, doc bigint, context bigint").distinct())
    counts = cut(seen.select("word", "toxic", "context").distinct().groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")))
    size = counts.agg(F.count("*"), F.sum("t"), F.sum("c")).first()
    if not size[0]:
        return silent
    # By chance a word is in toxic documents alone so often, among as many words, in one sample of twenty at most (Chernoff's bound).
    share, t, c = size[1] / (size[1] + size[2]), F.col("t"), F.col("c")
    n = t + c
    unlikely = t * F.log(t / n / share) + F.when(c > 0, c * F.log(c / n / (1 - share))).otherwise(0.0) if 0 < share < 1 else F.lit(0.0)
    only = counts.where("t > c and t >= 2").withColumn("unlikely", unlikely).orderBy(F.desc("unlikely"), F.desc("t"), "word")
    seeds = [r.word for r in only.where((F.col("unlikely") >= math.log(size[0] / 0.05)) & (t >= 3)).collect()] or [r.word for r in only.limit(FEW).collect()]
    clean = counts.where("c > t or c > 2").join(F.broadcast(spark.createDataFrame([(w,) for w in seeds], "word string")), "word", "left_anti").select("word", "c")
    top = [(r.word, r.c) for r in clean.orderBy(F.desc("c"), F.xxhash64("word"), "word").limit(COMMON + RARE_STEP * RARE).collect()]
    good = top[:COMMON] + top[COMMON::RARE_STEP]
    lone = cut(lone_words(seen, counts).repartition(spark.sparkContext.defaultParallelism, "doc"))
    clean = cut(clean.repartition(spark.sparkContext.defaultParallelism, "word"))
    machine = train(seeds, good, lambda m, p: best_words(lone, m, p), lambda m, n: hardest_words(clean, m, n))
    if not machine.landmarks:
        return silent
    got = scored(sample, machine, ["toxic", "apart"]).select("margin", "second", "toxic", "apart").collect()
    left_out = [r for r in got if r.apart]
    got = left_out if len({r.toxic for r in left_out}) == 2 else got  # too few labels for a fold of both kinds
    calibrate(machine, np.array([(r.margin, r.second) for r in got]), np.array([r.toxic for r in got], float))
    return machine


def scored(docs: DataFrame, machine: Machine, keep: list[str]) -> DataFrame:
    """docs' columns in keep, the two largest margins and the score of every row."""
    key = f"{hash((tuple(machine.landmarks), machine.alpha.tobytes(), machine.bias))}"
    cols = list(dict.fromkeys([*keep, "text"]))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                m = document_margins(machine, key, [x.decode() for x in as_bytes(part.column("text"))])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(m[:, 0]), pa.array(m[:, 1]), pa.array(curve(machine, m))], names=[*keep, "margin", "second", "score"])
        _MEMORY.clear()
        release()

    src = docs.select(*cols)
    return src.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name in keep), "margin double", "second double", "score double"]))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    ready(docs.sparkSession)
    rows = scored(docs, learn(docs, labels), ["doc_id"])
    held = F.coalesce(crc32_text(F.col("doc_id")) % 4 == 2, F.lit(True))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without the rows that judge() predicts toxic."""
    ready(docs.sparkSession)
    names = docs.columns
    taken = {n.lower() for n in names} & {"margin", "second", "score"}
    safe = docs.withColumnsRenamed({n: f"{n}__in" for n in names if n.lower() in taken})
    rows = scored(safe, learn(docs, labels), safe.columns).where(F.col("score") < threshold)
    return rows.select(*(F.col(f"{n}__in").alias(n) if n.lower() in taken else F.col(n) for n in names))
