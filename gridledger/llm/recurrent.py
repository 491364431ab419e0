"""Language-model scoring: a gated recurrent model with a class-factored output softmax, in numpy.

Tokens are words [^\\x20\\x09-\\x0D]+ of the text with A-Z in lower case, then one end. Learning rows are those whose
crc32(doc_id as text) mod 5 is not 1; a null doc_id is held out. Null texts are empty: their one token is the end. Repeated
rows are scored each; without learning rows every score is that of the first weights; an empty table gives no rows.

Counts. Every task numbers the distinct tokens of each chunk of documents. Rows (token, chunk, number in the chunk, count
there) meet once, by the token's 128-bit hash: their sum, exact and over the whole corpus, is the token's count, and goes
back to the chunks. A chunk has one row of a token, however frequent, so no token holds more than one row in some hundred
thousand. Two of 10^10 different tokens share a hash with probability 10^-19.

Symbols. The head (the most frequent words; HEAD_ROOTS times the root of the number of distinct tokens, so that the model
grows with the corpus), the end and the unknown word are symbols of their own; every other word is the tail symbol of its
first two and last one byte. A class is a run of symbols, as many as there are classes. The model reads symbols and gives
P(class | state) P(symbol | class, state); a tail word is then drawn from its symbol's words by count, so that all words and
the unknown one together have probability 1. In learning, words that occur once stand for the unknown word half the time.

Learning. ROUNDS deals the learning documents into rounds. In a round every task trains a copy of the weights by truncated
backpropagation on its documents of that round, and the copies are averaged by tokens, in groups, then over groups. Every
token of every learning document trains once.

Scoring. Documents are laid end to end in lanes; the state is carried from window to window until a document's end, so every
token is conditioned on all before it.

Reruns over the same files agree: chunks are numbered by task and place, and sums run in a fixed order.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridledger.llm.shared import as_bytes, crc32_text, discard, fresh_dir, ready

HEAD_ROOTS, TAIL_SHARE, HIDDEN = 1, 4, 16
#: Bytes of text of a chunk and tokens of a page (but for one document); streams and steps of a training window; scoring lanes and tokens scored at a time.
CHUNK_BYTES, PAGE_TOKENS, STREAMS, WINDOW, LANES, TOGETHER = 32 << 20, 1 << 17, 512, 16, 512, 4 << 20
#: The eighths of the learning documents that each round of averaging trains on, and the rate of learning.
ROUNDS, RATE = ((0,), (1,), (2, 3), (4, 5, 6, 7)), 1.2e-2
#: Logits lie within this; the exponentials of a class then never overflow.
LOGIT = np.float32(60)
UNKNOWN, END = 0, 1


def tokens_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def shape_of(word: bytes) -> int:
    return zlib.crc32(word[:2] + word[-1:]) & 0x7FFFFFFF


@dataclass(frozen=True)
class Layout:
    """Symbols: unknown, end, head words by rank, tails. Class k has the symbols from k * width on."""

    head: int
    tails: int
    width: int

    @classmethod
    def of(cls, distinct: int) -> Layout:
        head = min(distinct, HEAD_ROOTS * math.isqrt(distinct))
        tails = max(1, head // TAIL_SHARE)
        return cls(head, tails, math.isqrt(1 + head + tails) + 1)

    @property
    def symbols(self) -> int:
        return 2 + self.head + self.tails

    @property
    def classes(self) -> int:
        return -(-self.symbols // self.width)

    @property
    def kind(self) -> str:
        """The type that holds a symbol, or a symbol plus the number of symbols."""
        return "<u2" if 2 * self.symbols <= 1 << 16 else "<u4"

    def members(self, k: int) -> slice:
        return slice(k * self.width, min(self.symbols, (k + 1) * self.width))


def initial(layout: Layout, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Weights that start from the symbols' own frequencies; the last row of c and the last column of w are biases."""
    rng, s, h = np.random.default_rng(7), layout.symbols, HIDDEN
    p = counts + 0.5
    mass = np.array([p[layout.members(k)].sum() for k in range(layout.classes)])
    return {
        "x": rng.normal(0, 0.1, (s, 3 * h)).astype(np.float32),
        "u": rng.normal(0, 0.5 / math.sqrt(h), (h, 3 * h)).astype(np.float32),
        "b": np.zeros(3 * h, np.float32),
        "c": np.vstack([np.zeros((h, layout.classes)), np.log(mass / mass.sum())]).astype(np.float32),
        "w": np.hstack([np.zeros((s, h)), np.concatenate([np.log(p[m] / p[m].sum()) for m in map(layout.members, range(layout.classes))])[:, None]]).astype(np.float32),
    }


def step(p: dict, h: np.ndarray, symbols: np.ndarray):
    """One step of the gated unit: gates z, r and the candidate n; the new state is z h + (1 - z) n."""
    k = HIDDEN
    a = p["x"].take(symbols, 0)
    a += p["b"]
    g = a[:, : 2 * k] + h @ p["u"][:, : 2 * k]
    g *= 0.5
    np.tanh(g, out=g)
    g += 1
    g *= 0.5
    z, r = g[:, :k], g[:, k:]
    n = (r * h) @ p["u"][:, 2 * k :]
    n += a[:, 2 * k :]
    np.tanh(n, out=n)
    return n + z * (h - n), z, r, n


def _softmax(a: np.ndarray):
    """Logits within LOGIT, their exponentials, and the sums of those."""
    np.clip(a, -LOGIT, LOGIT, out=a)
    e = np.exp(a)
    return a, e, e @ np.ones(e.shape[1], e.dtype)


def _with_one(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """These rows of the states, and a one for the biases."""
    out = np.empty((len(rows), h.shape[1] + 1), h.dtype)
    out[:, :-1], out[:, -1] = h[rows], 1
    return out


def _by_symbol(layout: Layout, y: np.ndarray):
    """An order of the rows by symbol, the symbols in it, and where each class begins."""
    order = np.argsort(y.astype(layout.kind), kind="stable")
    q = y[order]
    return order, q, np.searchsorted(q, np.arange(layout.classes + 1) * layout.width).tolist()


def log_probability(p: dict, layout: Layout, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """ln P(symbol y | state h), rows of h."""
    order, q, edges = _by_symbol(layout, y)
    s, rows = _with_one(h, order), np.arange(len(y))
    a, _, total = _softmax(s @ p["c"])
    got = a[rows, q // layout.width].astype(np.float64) - np.log(total)
    for k, (i, j) in enumerate(zip(edges, edges[1:])):
        if i < j:
            m = layout.members(k)
            a, _, total = _softmax(s[i:j] @ p["w"][m].T)
            got[i:j] += a[rows[: j - i], q[i:j] - m.start] - np.log(total)
    out = np.empty(len(y))
    out[order] = got
    return out


def backward(p: dict, layout: Layout, h0: np.ndarray, xs: np.ndarray, ys: np.ndarray, fresh: np.ndarray):
    """Loss and gradients over one window of [steps, streams], and the last state; fresh marks inputs that start a document.

    Where ys is negative there is no token. The gradient "x" is a pair: the symbols that the window reads, and their rows.
    """
    t, n = xs.shape
    k = HIDDEN
    keep, h = [], h0
    states = np.empty((t, n, k), h0.dtype)
    for i in range(t):
        h = h * ~fresh[i][:, None]
        new, z, r, cand = step(p, h, xs[i])
        keep.append((h, z, r, cand))
        states[i] = h = new
    g = {name: np.zeros_like(p[name]) for name in ("u", "w")}
    flat, at = states.reshape(-1, k), np.flatnonzero(ys.ravel() >= 0)
    order, q, edges = _by_symbol(layout, ys.ravel()[at])
    at = at[order]
    s, rows = _with_one(flat, at), np.arange(len(at))
    a, e, total = _softmax(s @ p["c"])
    c = q // layout.width
    loss = float(np.log(total).sum()) - float(a[rows, c].sum())
    e /= total[:, None]
    e[rows, c] -= 1
    g["c"] = s.T @ e
    ds = e @ p["c"][:k].T
    for m, (i, j) in zip(map(layout.members, range(layout.classes)), zip(edges, edges[1:])):
        if i < j:
            own, place = s[i:j], q[i:j] - m.start
            a, e, total = _softmax(own @ p["w"][m].T)
            loss += float(np.log(total).sum()) - float(a[rows[: j - i], place].sum())
            e /= total[:, None]
            e[rows[: j - i], place] -= 1
            g["w"][m] = e.T @ own
            ds[i:j] += e @ p["w"][m, :k]
    dh = np.zeros((t * n, k), h0.dtype)
    dh[at] = ds
    dh = dh.reshape(t, n, k)
    uz, un = p["u"][:, : 2 * k], p["u"][:, 2 * k :]
    # What a step multiplies its gradients by, over all steps at once: of the candidate, of z and of r.
    hs, zs, rs, ns = (np.array(x) for x in zip(*keep))
    away, rh = 1 - zs, rs * hs
    of_n, of_z, of_r = away * (1 - ns * ns), away * (hs - ns) * zs, rh * (1 - rs)
    later, das = np.zeros((n, k), h0.dtype), np.empty((t, n, 3 * k), h0.dtype)
    for i in range(t - 1, -1, -1):
        dn = later + dh[i]
        da_n = dn * of_n[i]
        drh = da_n @ un.T
        da = das[i]
        da[:, :k], da[:, k : 2 * k], da[:, 2 * k :] = dn * of_z[i], drh * of_r[i], da_n
        dn *= zs[i]
        drh *= rs[i]
        dn += drh
        dn += da[:, : 2 * k] @ uz.T
        later = dn * ~fresh[i][:, None]
    # The products over all steps at once.
    flat_da = das.reshape(-1, 3 * k)
    g["u"][:, : 2 * k], g["u"][:, 2 * k :] = hs.reshape(-1, k).T @ flat_da[:, : 2 * k], rh.reshape(-1, k).T @ flat_da[:, 2 * k :]
    g["b"] = flat_da.sum(0)
    order = np.argsort(xs.ravel().astype(layout.kind), kind="stable")
    read = xs.ravel()[order]
    starts = np.flatnonzero(np.r_[True, read[1:] != read[:-1]])
    g["x"] = (read[starts], np.add.reduceat(flat_da[order], starts, 0))
    return loss, g, states[-1]


class Trainer:
    """Truncated backpropagation over a stream of documents, dealt into STREAMS lanes; steps are scaled by the gradients' mean squares."""

    def __init__(self, p: dict, layout: Layout, rate: float):
        self.p, self.layout, self.rate = {k: v.copy() for k, v in p.items()}, layout, rate
        self.v = {k: np.zeros_like(x) for k, x in p.items()}
        self.t, self.loss, self.tokens = 0, 0.0, 0
        self.pending: list[np.ndarray] = []
        self.held = 0

    def add(self, symbols: np.ndarray) -> None:
        """One document's symbols, its end last."""
        self.pending.append(symbols)
        self.held += len(symbols)
        if self.held >= STREAMS * WINDOW * 16:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        y = np.concatenate(self.pending).astype(np.int64)
        self.pending, self.held = [], 0
        lanes = max(1, min(STREAMS, len(y) // WINDOW))
        steps = -(-len(y) // lanes)
        x = np.concatenate([[END], y[:-1], np.full(steps * lanes - len(y), END)]).reshape(lanes, -1).T
        y = np.concatenate([y, np.full(steps * lanes - len(y), -1)]).reshape(lanes, -1).T
        h = np.zeros((lanes, HIDDEN), np.float32)
        for s in range(0, steps, WINDOW):
            xs, ys = x[s : s + WINDOW], y[s : s + WINDOW]
            n = int((ys >= 0).sum())
            if n:
                loss, g, h = backward(self.p, self.layout, h, xs, ys, xs == END)
                self.update(g, n)
                self.loss += loss
                self.tokens += n

    def update(self, g: dict, n: int) -> None:
        self.t += 1
        parts = {k: (slice(None), x) if k != "x" else x for k, x in g.items()}
        norm = math.sqrt(sum(float(np.vdot(x, x)) for _, x in parts.values())) / n
        scale = np.float32(min(1.0, 1.0 / max(norm, 1e-9)) / n)
        rate = np.float32(self.rate * math.sqrt(1 - 0.99**self.t))
        for k, (at, x) in parts.items():
            x = x * scale
            v = self.v[k][at]
            v += np.float32(0.01) * (x * x - v)
            self.v[k][at] = v
            x *= rate
            x /= np.sqrt(v) + np.float32(1e-6)
            self.p[k][at] -= x


def score_documents(p: dict, layout: Layout, docs: list[np.ndarray]) -> np.ndarray:
    """ln P of each document's symbols: documents end to end in lanes of like length; a state is carried through all windows of a document."""
    lengths = np.array([len(d) for d in docs], np.int64)
    if not lengths.sum():
        return np.zeros(len(docs))
    lanes = int(max(1, min(LANES, len(docs), lengths.sum() // lengths.max())))
    loads = [(0, i) for i in range(lanes)]
    order = np.argsort(-lengths, kind="stable").tolist()
    places = []
    for i in order:
        load, lane = heapq.heappop(loads)
        places.append((load, lane))
        heapq.heappush(loads, (load + int(lengths[i]), lane))
    y = np.full((lanes, max(loads)[0]), -1, np.int32)
    fresh = np.zeros(y.shape, bool)
    for i, (at, lane) in zip(order, places):
        y[lane, at : at + lengths[i]] = docs[i]
        fresh[lane, at : at + 1] = True
    y, fresh = y.T.copy(), fresh.T.copy()
    got = np.zeros(y.shape)
    h, last = np.zeros((lanes, HIDDEN), np.float32), np.full(lanes, END, np.int32)
    for s in range(0, len(y), WINDOW):
        ys = y[s : s + WINDOW]
        states = np.empty((*ys.shape, HIDDEN), np.float32)
        for t in range(len(ys)):
            new = fresh[s + t]
            h, *_ = step(p, h * ~new[:, None], np.where(new, END, last))
            states[t] = h
            last = np.maximum(ys[t], 0)
        own = ys >= 0
        got[s : s + WINDOW][own] = log_probability(p, layout, states[own], ys[own])
    sums = got.T.ravel()
    out = np.zeros(len(docs))
    for i, (at, lane) in zip(order, places):
        out[i] = sums[lane * len(y) + at : lane * len(y) + at + lengths[i]].sum()
    return out


CHUNKS = "kind int, chunk bigint, pos int, h1 bigint, h2 bigint, shape int, n bigint, page int, docs array<bigint>, learn binary, lengths binary, codes binary"


def chunks(docs: DataFrame) -> DataFrame:
    """Rows of two kinds. kind 0, a token of a chunk: its number there, hash, shape and count in learning documents. kind 1, a page of it: doc ids, learn flags, lengths, tokens' numbers."""

    def run(batches):
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        kinds = {"kind": pa.int32(), "chunk": pa.int64(), "pos": pa.int32(), "h1": pa.int64(), "h2": pa.int64(), "shape": pa.int32(), "n": pa.int64(), "page": pa.int32(), "docs": pa.list_(pa.int64()), "learn": pa.binary(), "lengths": pa.binary(), "codes": pa.binary()}

        def rows(size: int, **has) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(has[k], t) if k in has else pa.nulls(size, t) for k, t in kinds.items()], names=list(kinds))

        first = TaskContext.get().partitionId() << 32
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        counts, size, page, ids, flags, codes = np.zeros(0, np.int64), 0, 0, [], [], []

        def number_of(words):
            return np.fromiter(map(number.__getitem__, words), np.int32, len(words))

        def end_page():
            nonlocal counts, page, ids, flags, codes
            lengths, learn, every = np.array([len(c) for c in codes]), np.array(flags, bool), np.concatenate(codes)
            counts = np.concatenate([counts, np.zeros(len(number) - len(counts), np.int64)])
            counts += np.bincount(every[np.repeat(learn, lengths)], minlength=len(number))
            out = rows(1, kind=[1], chunk=[first], page=[page], docs=[ids], learn=[learn.tobytes()], lengths=[lengths.astype("<i4").tobytes()], codes=[every.astype("<i4").tobytes()])
            page, ids, flags, codes = page + 1, [], [], []
            return out

        def end_chunk():
            nonlocal first, counts, size, page
            words = list(number)
            for i in range(0, len(words), 100_000):
                part = words[i : i + 100_000]
                h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in part), "<i8").reshape(-1, 2)
                k = len(part)
                yield rows(k, kind=np.zeros(k, np.int32), chunk=np.full(k, first), pos=np.arange(i, i + k, dtype=np.int32), h1=h[:, 0], h2=h[:, 1], shape=np.array([shape_of(w) for w in part], np.int32), n=counts[i : i + k])
            number.clear()
            first, counts, size, page = first + 1, np.zeros(0, np.int64), 0, 0

        held = 0
        for b in batches:
            for doc, learn, text in zip(b.column("doc_id").to_pylist(), b.column("learn").to_pylist(), as_bytes(b.column("text"))):
                ids.append(doc), flags.append(learn), codes.append(number_of(tokens_of(text)))
                held, size = held + len(codes[-1]) + 1, size + len(text)
                if held >= PAGE_TOKENS or size >= CHUNK_BYTES:
                    yield end_page()
                    held = 0
                if size >= CHUNK_BYTES:
                    yield from end_chunk()
        if ids:
            yield end_page()
        if page:
            yield from end_chunk()

    learn = F.coalesce(crc32_text(F.col("doc_id")) % 5 != 1, F.lit(False))
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", learn.alias("learn"))
    return src.mapInArrow(run, CHUNKS)


@dataclass(frozen=True)
class Corpus:
    """Exact counts of the learning tokens, ends included, and the symbols that follow from them."""

    layout: Layout
    total: int
    distinct: int
    end: int
    least: int  # the count of the last head word
    head: dict[tuple[int, int], int]  # (hash, count) of a head word to its symbol
    masses: np.ndarray  # of each tail: its words' counts, each plus a half


def encode(words: DataFrame, pages: DataFrame, corpus: Corpus) -> DataFrame:
    """One row for each page: documents, their symbols (plus the number of symbols where the word occurs once), and what does not depend on the state."""
    layout, least = corpus.layout, corpus.least
    shared = words.sparkSession.sparkContext.broadcast(corpus)
    # What decides a token's symbol: a head word's hash, or the tail.
    sign = F.when(F.col("c") >= least, F.col("h1")).otherwise(F.col("shape") % layout.tails)
    given = words.select("chunk", "pos", "c", sign.alias("sign"))

    def run(tokens, own):
        import pyarrow as pa

        k = shared.value
        log_base = math.log10(k.total + 0.5 * (k.distinct + 1))
        at, n, sign = (tokens.column(x).to_numpy() for x in ("pos", "c", "sign"))
        c, symbol, share = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at))
        c[at] = n
        which = np.where(n > 0, 2 + k.layout.head + sign % k.layout.tails, UNKNOWN)
        often = np.flatnonzero(n >= k.least)
        # A word as frequent as the last head word, but not of the head, has the tail of its hash.
        which[often] = [k.head.get(x, y) for x, y in zip(zip(sign[often].tolist(), n[often].tolist()), which[often].tolist())]
        symbol[at] = which
        tail = symbol >= 2 + k.layout.head
        share[tail] = np.log10((c[tail] + 0.5) / k.masses[symbol[tail] - 2 - k.layout.head])
        base = np.log10(c + 0.5) - log_base
        stored = symbol + k.layout.symbols * ((c == 1) & tail)
        out = []
        for r in sorted(own.to_pylist(), key=lambda r: r["page"]):
            lengths, codes = np.frombuffer(r["lengths"], "<i4"), np.frombuffer(r["codes"], "<i4")
            docs = np.repeat(np.arange(len(lengths)), lengths)
            add = lambda x: np.bincount(docs, x[codes], len(lengths))
            out.append(
                {
                    "chunk": r["chunk"], "page": r["page"], "docs": r["docs"], "learn": r["learn"], "lengths": (lengths + 1).astype("<i4").tobytes(),
                    "symbols": np.insert(stored[codes], np.cumsum(lengths), END).astype(k.layout.kind).tobytes(),
                    "known": (add(c > 0) + (k.end > 0)).astype("<i8").tobytes(), "base": (add(base) + math.log10(k.end + 0.5) - log_base).astype("<f8").tobytes(), "shares": add(share).astype("<f8").tobytes(),
                }
            )
        kinds = [("chunk", pa.int64()), ("page", pa.int32()), ("docs", pa.list_(pa.int64())), *((x, pa.binary()) for x in ("learn", "lengths", "symbols", "known", "base", "shares"))]
        return pa.Table.from_pylist(out, pa.schema(kinds))

    kind = "chunk bigint, page int, docs array<bigint>, learn binary, lengths binary, symbols binary, known binary, base binary, shares binary"
    return given.groupBy("chunk").cogroup(pages.groupBy("chunk")).applyInArrow(run, kind)


def pack(p: dict) -> bytes:
    return b"".join(p[k].astype("<f4").tobytes() for k in sorted(p))


def unpack(raw: bytes, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size * 4
        out[k] = np.frombuffer(raw[at : at + n], "<f4").reshape(like[k].shape).astype(np.float32)
        at += n
    return out


def averaged(rows: DataFrame, like: dict, groups: int = 32) -> dict:
    """The token-weighted mean of rows (task, tokens, weights): first in groups of tasks, then over groups, in order."""

    def mean(batches):
        import pyarrow as pa

        total: dict = {}
        for b in batches:
            for task, n, w in zip(b.column("task").to_pylist(), b.column("tokens").to_pylist(), b.column("weights").to_pylist()):
                g = task % groups
                n0, w0 = total.get(g, (0, 0.0))
                total[g] = (n0 + n, w0 + n * np.frombuffer(w, "<f4").astype(np.float64))
        for g, (n, w) in total.items():
            yield pa.RecordBatch.from_pydict({"task": pa.array([g], pa.int32()), "tokens": pa.array([n], pa.int64()), "weights": [(w / max(1, n)).astype("<f4").tobytes()]})

    kind = "task int, tokens bigint, weights binary"
    got = rows.repartition(groups, F.col("task") % groups).sortWithinPartitions("task").mapInArrow(mean, kind).where("tokens > 0").collect()
    if not got:
        return like
    got.sort(key=lambda r: r.task)
    n = np.array([r.tokens for r in got], np.float64)
    total = sum(x * np.frombuffer(r.weights, "<f4").astype(np.float64) for x, r in zip(n / n.sum(), got))
    return unpack(total.astype("<f4").tobytes(), like)


def trained(made: DataFrame, layout: Layout, p: dict, eighths: tuple[int, ...], rate: float) -> dict:
    """The weights after one round over the learning documents whose place in their page, mod 8, is in eighths."""
    sc = made.sparkSession.sparkContext
    shared = sc.broadcast((layout, p))  # of a size that grows as the root of the distinct tokens

    def learn(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        layout, p = shared.value
        t = Trainer(p, layout, rate)
        for b in batches:
            for r in b.to_pylist():
                every = np.frombuffer(r["symbols"], layout.kind).astype(np.int64)
                once = every >= layout.symbols
                # Words that occur once stand for the unknown word, every other time.
                every = np.where(once, np.where(np.arange(len(every)) % 2 == 0, UNKNOWN, every - layout.symbols), every)
                flags = np.frombuffer(r["learn"], bool)
                for i, own in enumerate(np.split(every, np.cumsum(np.frombuffer(r["lengths"], "<i4"))[:-1])):
                    if flags[i] and i % 8 in eighths:
                        t.add(own)
        t.flush()
        if t.tokens:
            yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()], pa.int32()), "tokens": pa.array([t.tokens], pa.int64()), "weights": [pack(t.p)]})

    out = averaged(made.select("learn", "lengths", "symbols").mapInArrow(learn, "task int, tokens bigint, weights binary"), p)
    shared.destroy()
    return out


def corpus_of(words: DataFrame, end: int) -> tuple[Corpus, np.ndarray]:
    """The counts, and the symbols' own counts; words: (h1, shape, c, first), one row with `first` for each distinct token."""
    one = words.where("first and c > 0")
    size = one.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count(F.when(F.col("c") == 1, 1)).alias("once")).first()
    total, distinct = int(size.n) + end, int(size.v) + (end > 0)
    layout = Layout.of(int(size.v))
    top = one.orderBy(F.desc("c"), "h1").limit(layout.head).select("h1", "c").collect()
    last = top[-1] if top else None
    out = F.lit(True) if last is None else (F.col("c") < last.c) | ((F.col("c") == last.c) & (F.col("h1") > last.h1))
    least = last.c if last else 1 << 62
    # The tail of a word, as encode() finds it.
    tail = F.pmod(F.when(F.col("c") >= least, F.col("h1")).otherwise(F.col("shape") % layout.tails), F.lit(layout.tails))
    masses, sums = np.zeros(layout.tails), np.zeros(layout.tails)
    for r in one.where(out).groupBy(tail.alias("k")).agg(F.sum(F.col("c") + 0.5).alias("mass"), F.sum("c").alias("n")).collect():
        masses[r.k], sums[r.k] = r.mass, r.n
    head = {(r.h1, r.c): i + 2 for i, r in enumerate(top)}
    return Corpus(layout, total, distinct, end, least, head, masses), np.array([size.once / 2, end, *(r.c for r in top), *sums], np.float64)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    spark = ready(docs.sparkSession)
    found, summed, coded = (fresh_dir(spark, f"lm-{x}") for x in ("chunks", "words", "pages"))
    chunks(docs).write.option("compression", "zstd").parquet(found)
    rows = spark.read.schema(CHUNKS).parquet(found)
    same = Window.partitionBy("h1", "h2")
    tokens = rows.where("kind = 0").select("chunk", "pos", "h1", "h2", "shape", "n")
    tokens.select("chunk", "pos", "h1", "shape", F.sum("n").over(same).alias("c"), (F.col("chunk") == F.min("chunk").over(same)).alias("first")).write.option("compression", "zstd").parquet(summed)
    words = spark.read.parquet(summed)
    end = docs.where(F.coalesce(crc32_text(F.col("doc_id")) % 5 != 1, F.lit(False))).count()
    corpus, counts = corpus_of(words, end)
    layout = corpus.layout
    pages = rows.where("kind = 1").select("chunk", "page", "docs", "learn", "lengths", "codes")
    # Files small enough that the next stages share them out evenly, and not more than the corpus needs.
    share = max(8, min(256, pages.count() // (4 * spark.sparkContext.defaultParallelism)))
    encode(words, pages, corpus).write.option("compression", "zstd").option("maxRecordsPerFile", share).parquet(coded)
    discard(spark, found), discard(spark, summed)
    made = spark.read.parquet(coded)
    p = initial(layout, counts)
    for i, eighths in enumerate(ROUNDS):
        p = trained(made, layout, p, eighths, RATE / (i + 1) ** 0.5)
    final = spark.sparkContext.broadcast((layout, corpus.total, p))

    def run(batches):
        import pyarrow as pa

        layout, total, p = final.value

        def emit(rows):
            lengths = np.concatenate([np.frombuffer(r["lengths"], "<i4") for r in rows])
            symbols = np.concatenate([np.frombuffer(r["symbols"], layout.kind) for r in rows]).astype(np.int32)
            symbols -= layout.symbols * (symbols >= layout.symbols)
            got = score_documents(p, layout, np.split(symbols, np.cumsum(lengths)[:-1])) / math.log(10)
            part = lambda k, t: np.concatenate([np.frombuffer(r[k], t) for r in rows])
            return pa.RecordBatch.from_arrays(
                [pa.array([d for r in rows for d in r["docs"]], pa.int64()), pa.array(~part("learn", bool)), pa.array(lengths.astype(np.int64)), pa.array(part("known", "<i8")), pa.array(np.full(len(lengths), total)), pa.array(part("base", "<f8")), pa.array(got + part("shares", "<f8"))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        rows, held = [], 0
        for b in batches:
            for r in b.to_pylist():
                rows.append(r)
                held += len(r["symbols"])
                if held >= TOGETHER * np.dtype(layout.kind).itemsize:
                    yield emit(rows)
                    rows, held = [], 0
        if rows:
            yield emit(rows)

    return made.select("docs", "learn", "lengths", "symbols", "known", "base", "shares").mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
