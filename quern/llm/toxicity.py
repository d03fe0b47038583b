"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text is a row of words, cut into windows of `WINDOW` words that overlap by half; every
window of the whole text is scored and the highest score counts. A word enters the network
by itself (how much likelier toxic documents hold it, and a learnt vector) and by its
characters (the same for its four-letter pieces: the highest, the mean, and a learnt mean
vector). Two recurrent layers read a window forwards and backwards, attention pools their
states, and a logistic unit scores the pool.

Training takes at most `TRAIN_TOXIC` and `TRAIN_CLEAN` labelled documents of the learning
folds, drawn by a hash of the id. As a label speaks of the document and not of a place in
it, each round trains on the windows that now score highest in their documents. Statistics
of a word come from the other half of the drawn documents than the one that is trained on.

Defined cases: a null or blank text is one empty window and gets that window's score. Without
labels every score is 0. A null doc_id is kept and not learnt from. Repeated rows each give a
row with the same score. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import forget, give_back, held_out, slices, small_batches

WINDOW = 32
STRIDE = 16
HIDDEN = 8
EMBED = 4
TRAIN_TOXIC = 1200
TRAIN_CLEAN = 3200
#: Longer documents are not drawn for training; every document is scored whole.
TRAIN_CHARS = 20_000
WORD_BINS = 1 << 18
PIECE_BINS = 1 << 17
EMBED_BINS = 1 << 14
INPUTS = 3 + 2 * EMBED
#: Words that a Python worker remembers before it starts afresh.
CACHE_WORDS = 200_000
#: Windows that run through the network at once.
BATCH = 2048

_STRIP = ".,;:!?|\"'()[]{}<>*#%&$"
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
OUT_DDL = "doc_id long, held_out boolean, score double, predicted int"


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin of each word, the bins of all its pieces in a row, and where each word's begin."""
    bare = [w.strip(_STRIP) or w for w in words]
    word = np.fromiter((zlib.crc32(w.encode()) for w in bare), np.uint32, len(bare))
    raw = np.frombuffer(("".join(f"^{w}$$$" for w in bare)).encode("utf-16-le"), np.uint16).astype(np.uint32)
    sizes = np.fromiter((len(w.encode("utf-16-le")) // 2 for w in bare), np.int64, len(bare))
    starts = np.concatenate(([0], np.cumsum(sizes + 4)[:-1])) if len(bare) else np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        mixed = ((raw[:-3] * np.uint32(2654435761) + raw[1:-2]) * np.uint32(2246822519) + raw[2:-1]) * np.uint32(3266489917) + raw[3:]
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(668265263)
        mixed ^= mixed >> np.uint32(13)
    # a word of n letters has n pieces: those that start at ^ and at its letters but the last
    count = np.maximum(sizes, 1)
    firsts = np.concatenate(([0], np.cumsum(count)[:-1])) if len(bare) else np.empty(0, np.int64)
    at = np.arange(int(count.sum())) - np.repeat(firsts, count) + np.repeat(starts, count)
    return word, mixed[at], firsts


class Vocabulary:
    """Words that are hashed once: the bin of each, and the bins of its pieces in a row."""

    def __init__(self, words: list[str]):
        self.word, self.piece, self.firsts = hashes(words)
        self.count = np.diff(np.append(self.firsts, len(self.piece)))

    def pieces(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces of some words, where each word's begin, and how many it has."""
        count = self.count[ids]
        firsts = np.cumsum(count) - count
        return self.piece[np.repeat(self.firsts[ids] - firsts, count) + np.arange(int(count.sum()))], firsts, count


class Odds:
    """How much likelier toxic documents hold a word, or a piece of one, than expected."""

    def __init__(self, documents: list[list[str]], toxic: np.ndarray, prior: float = 4.0):
        known: dict[str, int] = {}
        ids = [np.unique(np.fromiter((known.setdefault(w, len(known)) for w in d), np.int64, len(d))) for d in documents]
        vocabulary = Vocabulary(list(known))
        self.word = self._odds([np.unique(vocabulary.word[own] % WORD_BINS) for own in ids], toxic, WORD_BINS, prior)
        self.piece = self._odds([np.unique(vocabulary.pieces(own)[0] % PIECE_BINS) for own in ids], toxic, PIECE_BINS, prior)

    def of(self, vocabulary: Vocabulary, ids: np.ndarray) -> np.ndarray:
        """Three numbers for each of some words: its own odds, the highest and the mean of its pieces'."""
        if not len(ids):
            return np.zeros((0, 3), np.float32)
        piece, firsts, count = vocabulary.pieces(ids)
        odds = self.piece[piece % PIECE_BINS]
        return np.stack([self.word[vocabulary.word[ids] % WORD_BINS], np.maximum.reduceat(odds, firsts), np.add.reduceat(odds, firsts) / count.astype(np.float32)], axis=1)

    @staticmethod
    def _odds(bins: list[np.ndarray], toxic: np.ndarray, size: int, prior: float) -> np.ndarray:
        none = np.empty(0, np.uint32)
        every = np.bincount(np.concatenate([*bins, none]).astype(np.int64), minlength=size)
        own = np.bincount(np.concatenate([*(b for b, t in zip(bins, toxic, strict=True) if t), none]).astype(np.int64), minlength=size)
        return np.log((own + prior) / (every * (toxic.mean() if len(toxic) else 0.5) + prior)).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters, and the passes through them."""

    def __init__(self, odds: Odds, seed: int = 5):
        rng = np.random.default_rng(seed)

        def mat(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.odds = odds
        self.p = {
            "words": 0.1 * mat(EMBED_BINS, EMBED) * np.sqrt(EMBED_BINS).astype(np.float32),
            "pieces": 0.1 * mat(EMBED_BINS, EMBED) * np.sqrt(EMBED_BINS).astype(np.float32),
            "attend": mat(2 * HIDDEN), "out": mat(2 * HIDDEN), "bias": np.zeros(1, np.float32),
        }
        for d in "fb":
            self.p |= {f"W{d}": mat(INPUTS, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32), f"U{d}": mat(HIDDEN, 3 * HIDDEN)}

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """A row of INPUTS numbers for each word."""
        vocabulary, every = Vocabulary(words), np.arange(len(words))
        return self.inputs_of(vocabulary, every, self.odds.of(vocabulary, every))

    def inputs_of(self, vocabulary: Vocabulary, ids: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, tuple]:
        """The same for some words of a vocabulary, whose odds are known."""
        if not len(ids):
            none = np.empty(0, np.int64)
            return np.zeros((0, INPUTS), np.float32), (none, none, none, np.empty(0, np.float32))
        word, (piece, firsts, count) = vocabulary.word[ids] % EMBED_BINS, vocabulary.pieces(ids)
        piece, count = piece % EMBED_BINS, count.astype(np.float32)
        x = np.empty((len(ids), INPUTS), np.float32)
        x[:, :3] = odds
        x[:, 3 : 3 + EMBED] = self.p["words"][word]
        x[:, 3 + EMBED :] = np.add.reduceat(self.p["pieces"][piece], firsts) / count[:, None]
        return x, (word, piece, firsts, count)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """What a word adds to the gates of both directions."""
        return np.concatenate((x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]), axis=1)

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. gates: (windows, words, 6 * HIDDEN); mask: words that exist."""
        n, length, _ = gates.shape
        h3 = 3 * HIDDEN
        states = np.empty((n, length, 2 * HIDDEN), np.float32)
        trace: dict[str, list] = {"f": [], "b": []}
        for k, d in enumerate("fb"):
            u, h = self.p[f"U{d}"], np.zeros((n, HIDDEN), np.float32)
            for t in range(length) if d == "f" else range(length - 1, -1, -1):
                g = gates[:, t, k * h3 : (k + 1) * h3]
                hu = h @ u
                zr = _sigmoid(g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(g[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
                m = mask[:, t, None]
                nxt = h + m * (1 - z) * (new - h)
                if keep:
                    trace[d].append((t, h, z, r, new, hu[:, 2 * HIDDEN :], m))
                h = nxt
                states[:, t, k * HIDDEN : (k + 1) * HIDDEN] = h
        e = states @ self.p["attend"] - 1e9 * (1 - mask)
        e -= e.max(axis=1, keepdims=True)
        a = np.exp(e)
        a /= a.sum(axis=1, keepdims=True)
        pooled = np.einsum("bt,bth->bh", a, states)
        logits = pooled @ self.p["out"] + self.p["bias"][0]
        return (logits, (states, a, pooled, trace)) if keep else logits

    def backward(self, dlogit: np.ndarray, kept: tuple) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters behind the gates, and of the gates."""
        states, a, pooled, trace = kept
        n, length, _ = states.shape
        grad = {"out": pooled.T @ dlogit, "bias": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * self.p["out"]
        da = np.einsum("bh,bth->bt", dpool, states)
        de = a * (da - (a * da).sum(axis=1, keepdims=True))
        grad["attend"] = np.einsum("bt,bth->h", de, states)
        dstates = a[:, :, None] * dpool[:, None, :] + de[:, :, None] * self.p["attend"]
        h3 = 3 * HIDDEN
        dgates = np.zeros((n, length, 2 * h3), np.float32)
        for k, d in enumerate("fb"):
            u, du, dh = self.p[f"U{d}"], np.zeros((HIDDEN, h3), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t, h, z, r, new, hun, m in reversed(trace[d]):
                dh = dh + dstates[:, t, k * HIDDEN : (k + 1) * HIDDEN]
                dn = dh * m * (1 - z) * (1 - new * new)
                dz = -dh * m * (new - h) * z * (1 - z)
                dr = dn * hun * r * (1 - r)
                own = np.concatenate((dz, dr, dn), axis=1)
                dgates[:, t, k * h3 : (k + 1) * h3] = own
                through = np.concatenate((dz, dr, dn * r), axis=1)
                du += h.T @ through
                dh = dh * (1 - m * (1 - z)) + through @ u.T
            grad[f"U{d}"] = du
        return grad, dgates


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.step = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def move(self, grad: dict[str, np.ndarray]) -> None:
        self.step += 1
        fix = np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k, g in grad.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= self.rate * fix * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)


def windows(n_words: int) -> np.ndarray:
    """Where the windows of a text start; the last reaches the text's end."""
    return np.arange(0, max(n_words - STRIDE, 1), STRIDE)


def _cut(ids: list[np.ndarray], empty: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of many documents as word numbers, and the document of each window."""
    rows, owner = [], []
    for k, own in enumerate(ids):
        starts = windows(len(own))
        padded = np.full(int(starts[-1]) + WINDOW, empty, np.int32)
        padded[: len(own)] = own
        rows.append(padded[starts[:, None] + np.arange(WINDOW)])
        owner.append(np.full(len(starts), k, np.int32))
    return np.concatenate(rows), np.concatenate(owner)


def train(documents: list[str], toxic: list[int], rounds: int = 3, epochs: int = 6, seed: int = 5) -> Network | None:
    """A network for whole documents, of which only the label is known."""
    once: dict[str, str] = {}  # one string for each distinct word
    texts = [[once.setdefault(w, w) for w in words_of(t)] for t in documents]
    y = np.array(toxic, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    half = np.arange(len(texts)) % 2
    other = [Odds([t for t, h in zip(texts, half, strict=True) if h != k], y[half != k]) for k in (0, 1)]
    net = Network(other[0], seed)
    known: list[dict[str, int]] = [{}, {}]
    ids = [np.array([known[h].setdefault(w, len(known[h])) for w in t], np.int64) for t, h in zip(texts, half, strict=True)]
    shift = len(known[0])
    ids = [own + shift * h for own, h in zip(ids, half, strict=True)]
    empty = shift + len(known[1])
    every, owner = _cut(ids, empty)

    vocabulary = Vocabulary([*known[0], *known[1]])
    told = np.concatenate([other[0].of(vocabulary, np.arange(shift)), other[1].of(vocabulary, np.arange(shift, empty))])

    def inputs() -> np.ndarray:
        return np.concatenate([net.inputs_of(vocabulary, np.arange(empty), told)[0], np.zeros((1, INPUTS), np.float32)])

    adam = Adam(net.p, 0.01)
    x = inputs()
    rank = (np.maximum(x[:, 0], 0) + np.maximum(x[:, 1], 0))[every].max(axis=1)
    for _ in range(rounds):
        order = np.lexsort((-rank, owner))
        first = np.concatenate(([True], owner[order][1:] != owner[order][:-1]))
        best = order[first]
        second = order[1:][first[:-1] & ~first[1:]]  # clean documents teach by their next window too
        pick = np.concatenate((best, second[y[owner[second]] == 0]))
        for _ in range(epochs):
            rng.shuffle(pick)
            for at in range(0, len(pick), 256):
                rows = pick[at : at + 256]
                words, places = np.unique(every[rows], return_inverse=True)
                places = places.reshape(len(rows), WINDOW)
                x, mask = np.zeros((len(words), INPUTS), np.float32), (every[rows] != empty).astype(np.float32)
                own = words[words != empty]
                x[: len(own)], (word, piece, _, count) = net.inputs_of(vocabulary, own, told[own])
                logits, kept = net.forward(net.projected(x)[places], mask, keep=True)
                dlogit = ((_sigmoid(logits) - y[owner[rows]]) / len(rows)).astype(np.float32)
                grad, dgates = net.backward(dlogit, kept)
                flat = np.zeros((len(words), 6 * HIDDEN), np.float32)
                np.add.at(flat, places.ravel(), dgates.reshape(-1, 6 * HIDDEN))
                dx = np.zeros_like(x)
                for k, d in enumerate("fb"):
                    g = flat[:, 3 * HIDDEN * k : 3 * HIDDEN * (k + 1)]
                    grad[f"W{d}"], grad[f"b{d}"] = x.T @ g, g.sum(axis=0)
                    dx += g @ net.p[f"W{d}"].T
                grad["words"], grad["pieces"] = np.zeros_like(net.p["words"]), np.zeros_like(net.p["pieces"])
                np.add.at(grad["words"], word, dx[: len(own), 3 : 3 + EMBED])
                np.add.at(grad["pieces"], piece, np.repeat(dx[: len(own), 3 + EMBED :] / count[:, None], count.astype(int), axis=0))
                adam.move(grad)
        gates = net.projected(inputs())
        rank = np.concatenate([net.forward(gates[every[k : k + BATCH]], (every[k : k + BATCH] != empty).astype(np.float32)) for k in range(0, len(every), BATCH)])
    net.odds = Odds(texts, y)
    del every, owner, ids, rank, x, gates, adam
    give_back()
    return net


class Scorer:
    """Scores whole texts; remembers what a word adds to the gates."""

    def __init__(self, net: Network | None):
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.gates = np.zeros((1, 6 * HIDDEN), np.float32)  # row 0: no word
        self.size = 1

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        for w in words:
            self.known[w] = len(self.known) + 1
        new = self.net.projected(self.net.inputs(words)[0])
        if self.size + len(new) > len(self.gates):
            grown = np.zeros((2 * (self.size + len(new)), 6 * HIDDEN), np.float32)
            grown[: self.size] = self.gates[: self.size]
            self.gates = grown
        self.gates[self.size : self.size + len(new)] = new
        self.size += len(new)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if self.net is None or not texts:
            return np.zeros(len(texts))
        if len(self.known) > CACHE_WORDS:
            self._forget()
        split = [words_of(t) for t in texts]
        self._learn([w for w in set().union(*split) if w not in self.known])
        every, owner = _cut([np.fromiter(map(self.known.__getitem__, s), np.int64, len(s)) for s in split], 0)
        logits = np.empty(len(every), np.float32)
        for k in range(0, len(every), BATCH):
            rows = every[k : k + BATCH]
            logits[k : k + BATCH] = self.net.forward(self.gates[rows], (rows != 0).astype(np.float32))
        best = np.maximum.reduceat(logits, np.searchsorted(owner, np.arange(len(texts))))
        return _sigmoid(best.astype(np.float64))


def learn(docs: DataFrame, labels: DataFrame, most_toxic: int = TRAIN_TOXIC, most_clean: int = TRAIN_CLEAN) -> Network | None:
    """The network from a sample of labelled documents, bounded in rows and in characters a row."""
    marked = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    order = (F.xxhash64(F.col("doc_id"), F.lit("toxic")), F.col("doc_id"))
    drawn = marked.where("toxic = 1").orderBy(*order).limit(most_toxic).unionAll(marked.where("toxic = 0").orderBy(*order).limit(most_clean))
    texts = docs.select("doc_id", "text").where(F.length("text").between(1, TRAIN_CHARS))
    rows = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "toxic", "text").limit(2 * (most_toxic + most_clean)).collect()  # drawn has a fixed bound
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["toxic"], r["text"]))
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def _score(net: Network | None):
    def run(source):
        forget()
        scorer = Scorer(net)
        for batch in source:
            for piece in slices(batch, 128):
                score = scorer(piece.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], schema=_OUT)
        del scorer
        give_back()

    return run


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    return small_batches(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_score(net), OUT_DDL)


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the learning folds, then scores every row of docs."""
    return score(docs, learn(docs, labels))


def _clean(net: Network | None, at: int):
    def run(source):
        forget()
        scorer = Scorer(net)
        for batch in source:
            for piece in slices(batch, 128):
                yield piece.filter(pa.array(scorer(piece.column(at).to_pylist()) < 0.5))
        del scorer
        give_back()

    return run


def reject(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """The rows of docs whose whole text isn't predicted toxic, with all their columns."""
    return small_batches(docs).mapInArrow(_clean(net, docs.columns.index(text)), docs.schema)
