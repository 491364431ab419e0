"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The vocabulary is a SentencePiece model file. Where its scores are merge ranks and not log probabilities, a piece of rank r
scores -ln(r + 2) (Zipf's law). A text is a space marker, then its characters, each space a marker. Characters that no
piece starts with are taken alone at the least score - 10 and written as their UTF-8 bytes, by byte pieces. A marker
character in the text itself also goes by bytes, so that decoding gives every text back. Null and empty texts have no pieces.

No piece holds a marker after another character, so that words with the spaces before them are encoded apart, and each
distinct word once for every batch of texts (and a bounded number are remembered by the worker). A vocabulary that does
have such pieces is refused.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.llm.shared import as_bytes, ready

MARK = "▁"
#: A private stand-in for a marker character of the text itself: no UTF-8 text has this byte.
_LITERAL = 0xFF
_MARK, _LIT = MARK.encode(), bytes([_LITERAL])
UNKNOWN_PENALTY = 10.0
REMEMBER, LONGEST = 300_000, 48


@dataclass
class Vocabulary:
    """A double-array trie over the bytes of pieces (base, check, and the piece that ends at a slot), and tables by id."""

    base: np.ndarray
    check: np.ndarray
    piece_at: np.ndarray
    score: np.ndarray
    raw: list[bytes]
    byte_id: np.ndarray
    unknown: float


def build_trie(pieces: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of a node's children are base[node] + byte; check names the parent. Slot 0 is no node, slot 1 the root."""
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for p, i in pieces.items():
        at = 0
        for c in p:
            if c not in children[at]:
                children[at][c] = len(children)
                children.append({})
                ends.append(-1)
            at = children[at][c]
        ends[at] = i
    size = 2 * len(children) + 1024
    base, check, piece_at = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    taken = np.zeros(size, bool)
    taken[:2] = True
    slot, todo, low = {0: 1}, [0], 1
    for n in todo:
        kids = sorted(children[n])
        if not kids:
            continue
        first, rest = kids[0], np.array(kids[1:], np.int64) - kids[0]
        while taken[low]:
            low += 1
        at = max(low, first + 1)
        while True:
            if at + 4096 + 300 > len(taken):
                grow = lambda a, v: np.concatenate([a, np.full(len(a), v, a.dtype)])
                base, check, piece_at, taken = grow(base, 0), grow(check, -1), grow(piece_at, -1), grow(taken, False)
            free = ~taken[at : at + 4096]
            for r in rest:
                free &= ~taken[at + r : at + r + 4096]
            if free.any():
                at += int(free.argmax())
                break
            at += 4096
        base[slot[n]] = at - first
        for c in kids:
            s, kid = at - first + c, children[n][c]
            taken[s], check[s], piece_at[s], slot[kid] = True, slot[n], ends[kid], s
        todo.extend(children[n][c] for c in kids)
    used = int(np.flatnonzero(taken)[-1]) + 257
    pad = lambda a, v: np.concatenate([a[:used], np.full(max(0, used - len(a)), v, a.dtype)])
    return pad(base, 0), pad(check, -1), pad(piece_at, -1)


@lru_cache(maxsize=4)
def load_vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    scores = np.array([model.get_score(i) for i in range(n)])
    normal = np.array([not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)])
    ranks = bool(np.all(scores[normal] == np.round(scores[normal])))
    log = -np.log(2.0 - scores) if ranks else scores
    raw, byte_id, pieces = [], np.full(256, -1, np.int32), {}
    for i in range(n):
        p = model.id_to_piece(i)
        if model.is_byte(i):
            raw.append(bytes([int(p[1:-1], 16)]))
            byte_id[raw[-1][0]] = i
        else:
            raw.append(p.encode() if normal[i] else b"")
            if normal[i]:
                if MARK in p.lstrip(MARK):
                    raise ValueError(f"piece {p!r} holds a marker after another character")
                pieces[raw[-1]] = i
    if (byte_id < 0).any():
        raise ValueError("the vocabulary lacks byte pieces")
    unknown = float(log[normal].min() - UNKNOWN_PENALTY)
    log[byte_id] = unknown
    return Vocabulary(*build_trie(pieces), log, raw, byte_id, unknown)


def _char_len(lead: np.ndarray) -> np.ndarray:
    """Bytes of the character that starts with this byte; 0 within one."""
    out = np.ones(lead.shape, np.int8)
    out[lead >= 0xC0], out[lead >= 0xE0], out[lead >= 0xF0] = 2, 3, 4
    out[(lead >= 0x80) & (lead < 0xC0)] = 0
    out[lead == _LITERAL] = 1
    return out


def viterbi(v: Vocabulary, words: list[bytes]) -> list[np.ndarray]:
    """The best pieces of each word (bytes, with markers): all words move through the trie together. Ties keep the longer last piece."""
    n = len(words)
    length = np.fromiter(map(len, words), np.int64, n)
    width = int(length.max())
    text = np.zeros((n, width + 1), np.uint8)
    flat = np.frombuffer(b"".join(words), np.uint8)
    text[np.repeat(np.arange(n), length), np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    chars = _char_len(text)
    best = np.full((n, width + 5), -np.inf)
    best[:, 0] = 0
    piece, came = np.full((n, width + 5), -1, np.int32), np.zeros((n, width + 5), np.int32)
    for s in range(width):
        rows = np.flatnonzero((length > s) & (chars[:, s] > 0))
        if not len(rows):
            continue
        node, at, single, here = np.full(len(rows), 1, np.int32), s, np.zeros(n, bool), best[:, s]
        live = rows
        while len(live) and at < width:
            c = text[live, at]
            slot = v.base[node] + c
            ok = (v.check[slot] == node) & (length[live] > at)
            live, node, at = live[ok], slot[ok], at + 1
            ids = v.piece_at[node]
            end = ids >= 0
            if end.any():
                r, i = live[end], ids[end]
                single[r[chars[r, s] == at - s]] = True
                new = here[r] + v.score[i]
                up = new > best[r, at]
                r = r[up]
                best[r, at], piece[r, at], came[r, at] = new[up], i[up], s
        lone = rows[~single[rows]]
        if len(lone):
            to = s + chars[lone, s].astype(np.int64)
            new = here[lone] + v.unknown
            up = new > best[lone, to]
            best[lone[up], to[up]], piece[lone[up], to[up]], came[lone[up], to[up]] = new[up], -1, s
    out = []
    for w, end, p, f in zip(words, length.tolist(), piece, came):
        path = []
        while end > 0:
            start = int(f[end])
            path.append(int(p[end]) if p[end] >= 0 else w[start:end])
            end = start
        ids = []
        for x in reversed(path):
            ids.extend([x] if isinstance(x, int) else v.byte_id[list(_MARK if x == _LIT else x)].tolist())
        out.append(np.array(ids, "<u4"))
    return out


def viterbi_long(v: Vocabulary, word: bytes) -> np.ndarray:
    """The same for one word of any length, in memory proportional to it."""
    n, base, check, piece_at, score = len(word), v.base, v.check, v.piece_at, v.score
    chars = _char_len(np.frombuffer(word, np.uint8)).tolist()
    best, piece, came = [-np.inf] * (n + 5), [-1] * (n + 5), [0] * (n + 5)
    best[0] = 0.0
    for s in range(n):
        if not chars[s]:
            continue
        node, at, single, here = 1, s, False, best[s]
        while at < n:
            slot = base[node] + word[at]
            if check[slot] != node:
                break
            node, at = slot, at + 1
            if (i := int(piece_at[node])) >= 0:
                single |= at - s == chars[s]
                if (new := here + score[i]) > best[at]:
                    best[at], piece[at], came[at] = new, i, s
        if not single and (new := here + v.unknown) > best[to := s + chars[s]]:
            best[to], piece[to], came[to] = new, -1, s
    path, end = [], n
    while end > 0:
        start = came[end]
        path.append([piece[end]] if piece[end] >= 0 else v.byte_id[list(_MARK if word[start:end] == _LIT else word[start:end])].tolist())
        end = start
    return np.array([i for x in reversed(path) for i in x], "<u4")


def _words(text: bytes) -> list[bytes]:
    """Words, each with the spaces before it but one; the first space of a text is the marker that encoding adds."""
    if b"  " not in text and text[:1] != b" " and text[-1:] != b" ":
        return text.split(b" ")
    out, empty = [], b""
    for w in text.split(b" "):
        if w:
            out.append(empty + w)
            empty = b""
        else:
            empty += b" "
    # Spaces at the end are a word of markers only, one of which is added.
    return [*out, empty[1:]] if empty else out


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text (UTF-8), little-endian unsigned 32-bit."""
        known, split, fresh = self.known, [], set()
        if len(known) > REMEMBER:
            known.clear()
        for t in texts:
            words = _words(t) if t else []
            split.append(words)
            fresh.update(w for w in words if w not in known)
        marked = lambda w: (b" " + w).replace(_MARK, _LIT).replace(b" ", _MARK)
        short = sorted((w for w in fresh if len(w) <= LONGEST), key=len)
        for i in range(0, len(short), 4000):
            part = short[i : i + 4000]
            for w, ids in zip(part, viterbi(self.v, [marked(w) for w in part])):
                known[w] = ids.tobytes()
        long = [w for w in fresh if len(w) > LONGEST]
        for w in long:
            known[w] = viterbi_long(self.v, marked(w)).tobytes()
        out = [np.frombuffer(b"".join([known[w] for w in words]), "<u4") for words in split]
        for w in long:
            del known[w]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids: pieces one after another, markers to spaces, the marker that encoding added taken off."""
        v = self.v
        is_byte = np.isin(ids, v.byte_id)
        if is_byte.any():  # bytes that spell a marker are the text's own, so markers turn to spaces before they join
            raw = [v.raw[i] if b else v.raw[i].replace(_MARK, b" ") for i, b in zip(ids.tolist(), is_byte.tolist())]
            text = b"".join(raw)
        else:
            text = b"".join(map(v.raw.__getitem__, ids.tolist())).replace(_MARK, b" ")
        return text[1:] if text[:1] == b" " else text


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, score (sum of log scores), ids_crc32 (of ids as little-endian unsigned 32-bit), round_trip
    (decoding gave the text back) and, if asked, ids (those bytes) of every row of docs."""
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(load_vocabulary(model_path))  # a vocabulary's size, whatever the corpus

    def run(batches):
        import pyarrow as pa

        encoder = Encoder(shared.value)
        score, byte = shared.value.score, np.zeros(len(shared.value.raw), bool)
        byte[shared.value.byte_id] = True
        for b in batches:
            for part in (b.slice(i, 2000) for i in range(0, b.num_rows, 2000)):
                texts = as_bytes(part.column("text"))
                rows = encoder.encode(texts)
                cols = {
                    "doc_id": part.column("doc_id"),
                    "n_pieces": pa.array([len(x) for x in rows], pa.int64()),
                    "n_byte_pieces": pa.array([int(byte[x].sum()) for x in rows], pa.int64()),
                    "score": pa.array([float(score[x].sum()) for x in rows], pa.float64()),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in rows], pa.int64()),
                    "round_trip": pa.array([encoder.decode(x) == t for x, t in zip(rows, texts)], pa.bool_()),
                }
                if with_ids:
                    cols["ids"] = pa.array([x.tobytes() for x in rows], pa.binary())
                yield pa.RecordBatch.from_pydict(cols)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_pieces bigint, n_byte_pieces bigint, score double, ids_crc32 bigint, round_trip boolean" + ", ids binary" * with_ids)


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text of rows with ids as encode_documents writes them; null ids give the empty text."""
    spark = ready(encoded.sparkSession)
    shared = spark.sparkContext.broadcast(load_vocabulary(model_path))

    def run(batches):
        import pyarrow as pa

        encoder = Encoder(shared.value)
        for b in batches:
            texts = [encoder.decode(np.frombuffer(x or b"", "<u4")).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", F.col("ids").cast("binary").alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
