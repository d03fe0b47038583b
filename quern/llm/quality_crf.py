"""Line quality by a linear-chain conditional random field.

Each line of a document is described by a few yes/no features; the field labels the lines
content or boilerplate together (Viterbi), and the share of words in content lines decides
whether the document is kept. Base rules on whole documents come first.

The field is trained here, by gradient ascent on the likelihood, from all lines of at most
`TRAIN_DOCS` labelled documents of the learning folds. Only documents are labelled, not
lines, so lines get weak labels: a line is content or boilerplate by the odds of its features
between documents of quality 1 and 0, and a document's label holds for the share of its words
(content on at least `KEEP_SHARE` where quality is 1, on less where it is 0), for which the
least certain lines are turned. The field learnt from these labels them anew, under the same
constraint, and is trained once more.

Defined cases: a null text has no words and no lines: all counts 0, base_failed, not kept.
Blank lines are not labelled. Without labels the field calls every line content. Repeated
rows each give a row. A null doc_id is kept in the result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import held_out, slices, small_batches

TRAIN_DOCS = 3000
#: Longer documents are not drawn for training; every document is judged whole.
TRAIN_CHARS = 20_000
KEEP_SHARE = 0.5
MIN_WORDS = 50

FEATURES = (
    "bias", "words<4", "words<12", "words>60", "symbols>2%", "symbols>10%", "digits>10%", "digits>40%",
    "upper>30%", "upper>80%", "no_end_mark", "bars", "repeat>20%", "repeat>50%", "equal_before",
    "word_len<3", "word_len>9", "first", "last", "marks>15%",
)
SYMBOLS = "#*$%&|<>"
_GAPS = "\t\n\x0b\x0c\r "

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_OUT = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in COUNTS] + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64()), ("n_content_lines", pa.int64())])
OUT_DDL = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, content_share double, n_content_lines long"


def repeated(words: list[bytes]) -> np.ndarray:
    """True at each word inside a 3-word window that the text holds twice or more."""
    hit = np.zeros(len(words), bool)
    if len(words) < 4:
        return hit
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    most = len(seen)
    if most < 1 << 21:
        window = (ids[:-2] * most + ids[1:-1]) * most + ids[2:]
    else:
        pair = np.unique(ids[:-2] * most + ids[1:-1], return_inverse=True)[1]
        window = pair * most + ids[2:]
    order = np.argsort(window, kind="stable")
    ranked = window[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    for k in range(3):
        hit[k : len(window) + k] |= twice
    return hit


def base_counts(text: str) -> tuple[dict[str, int], list[bytes], np.ndarray]:
    words = text.encode().split()  # at exactly the bytes 20 and 09 to 0D
    hit = repeated(words)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(_GAPS):
            seen.add(line)
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, _GAPS)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": dup,
        "n_repeat_words": int(hit.sum()),
    }, words, hit


def base_failed(counts: dict[str, int]) -> bool:
    return counts["n_words"] < MIN_WORDS or 100 * counts["n_repeat_words"] > 50 * counts["n_words"]


_KINDS = np.zeros(256, np.uint8)
_KINDS[list(b"0123456789")] = 1
_KINDS[list(range(65, 91))] = 2
_KINDS[list(range(97, 123)) + list(range(128, 256))] = 3
_KINDS[[*SYMBOLS.encode()]] = 4
_KINDS[list(b"!?.,;:-_=~^@/\\\"'()[]{}")] = 5


def line_features(text: str, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of 0 and 1 for each line with a word, and the number of its words."""
    rows, sizes = [], []
    seen: set[bytes] = set()
    at = 0
    for line in text.encode().split(b"\n"):
        words = line.split()
        if not words:
            continue
        n = len(words)
        digits, upper, lower, symbols, marks = np.bincount(_KINDS[np.frombuffer(line, np.uint8)], minlength=6)[1:6].tolist()
        chars = max(1, len(line) - n + 1)
        letters = max(1, upper + lower)
        again = int(hit[at : at + n].sum())
        rows.append((
            1, n < 4, n < 12, n > 60, symbols > 0.02 * chars, symbols > 0.1 * chars, digits > 0.1 * chars, digits > 0.4 * chars,
            upper > 0.3 * letters, upper > 0.8 * letters, line.rstrip()[-1:] not in (b".", b"!", b"?"), line.count(b"|") > 2, again > 0.2 * n, again > 0.5 * n, line in seen,
            chars < 3 * n, chars > 9 * n, not rows, False, marks > 0.15 * chars,
        ))
        seen.add(line)
        sizes.append(n)
        at += n
    if rows:
        rows[-1] = rows[-1][:18] + (True,) + rows[-1][19:]
    return np.array(rows, np.float32).reshape(-1, len(FEATURES)), np.array(sizes, np.int64)


class Field:
    """Weights of the features for content (1) against boilerplate (0), and of transitions."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        self.weights = np.zeros(len(FEATURES)) if weights is None else weights
        self.moves = np.zeros((2, 2)) if moves is None else moves

    def viterbi(self, features: np.ndarray) -> list[int]:
        """The likeliest labels; ties go to content."""
        gains = (features @ self.weights).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        zero, one, back = 0.0, gains[0], []
        for g in gains[1:]:
            z0, z1, o0, o1 = zero + m00, one + m10, zero + m01, one + m11
            back.append((z1 >= z0, o1 >= o0))
            zero, one = max(z0, z1), g + max(o0, o1)
        label = int(one >= zero)
        labels = [label]
        for before in reversed(back):
            label = int(before[label])
            labels.append(label)
        return labels[::-1]

    @classmethod
    def trained(cls, sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 150, rate: float = 0.2, decay: float = 1e-3, start: Field | None = None) -> Field:
        """Forward-backward over whole sequences, and Adam on the mean likelihood, from `start` on.

        Lines lie by their place: all first ones, then all second ones, the longest sequence
        foremost, so that nothing is padded to the longest.
        """
        field = cls()
        sequences = sorted((s for s in sequences if len(s[1])), key=lambda s: -len(s[1]))
        if not sequences:
            return field
        sizes = np.array([len(y) for _, y in sequences])
        active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")
        begin = np.cumsum(active) - active
        owner = np.concatenate([np.arange(n) for n in active])
        place = np.repeat(np.arange(sizes[0]), active)
        ends = begin[sizes - 1] + np.arange(len(sizes))
        own = np.concatenate([begin[:n] + k for k, n in enumerate(sizes)])
        x, y = np.empty((len(owner), len(FEATURES))), np.empty(len(owner), int)
        x[own], y[own] = np.concatenate([f for f, _ in sequences]), np.concatenate([labels for _, labels in sequences])
        after = np.arange(len(sizes), len(owner))
        before = begin[place[after] - 1] + owner[after]
        seen_x = x.T @ y
        seen_m = np.array([[((y[before] == a) & (y[after] == b)).sum() for b in (0, 1)] for a in (0, 1)])
        theta, m, v = np.zeros(len(FEATURES) + 4) if start is None else np.concatenate((start.weights, start.moves.ravel())), 0.0, 0.0
        total = len(owner)
        for step in range(1, rounds + 1):
            weights, moves = theta[:-4], theta[-4:].reshape(2, 2)
            gain = np.stack([np.zeros(total), x @ weights], axis=1)
            ahead, behind = gain.copy(), np.zeros_like(gain)
            for t in range(1, sizes[0]):
                last = ahead[begin[t - 1] : begin[t - 1] + active[t]]
                ahead[begin[t] : begin[t] + active[t]] += np.logaddexp(last[:, :1] + moves[0], last[:, 1:] + moves[1])
            norm = np.logaddexp(ahead[ends, 0], ahead[ends, 1])[owner]
            for t in range(sizes[0] - 2, -1, -1):
                following = slice(begin[t + 1], begin[t + 1] + active[t + 1])
                inner = moves[None] + (gain[following] + behind[following])[:, None, :]
                behind[begin[t] : begin[t] + active[t + 1]] = np.logaddexp(inner[..., 0], inner[..., 1])
            share = np.exp(ahead + behind - norm[:, None])[:, 1]
            pair = np.exp(ahead[before][:, :, None] + moves + (gain + behind)[after][:, None, :] - norm[after][:, None, None])
            grad = np.concatenate((seen_x - x.T @ share, (seen_m - pair.sum(0)).ravel())) / total - decay * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        field.weights, field.moves = theta[:-4], theta[-4:].reshape(2, 2)
        return field


def line_odds(pages: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 200, decay: float = 1e-2) -> np.ndarray:
    """Weights of the features by which lines of good documents differ from those of bad ones, both kinds counted alike."""
    every = np.concatenate([x for x, _, _ in pages])
    quality = np.repeat([q for *_, q in pages], [len(x) for x, _, _ in pages])
    kinds, of = np.unique(every, axis=0, return_inverse=True)  # few: features are 0 or 1
    good, bad = (np.bincount(of.ravel()[quality == q], minlength=len(kinds)).astype(float) for q in (1, 0))
    good, bad = good / max(good.sum(), 1), bad / max(bad.sum(), 1)
    theta, m, v = np.zeros(len(FEATURES)), 0.0, 0.0
    for step in range(1, rounds + 1):
        share = 1 / (1 + np.exp(-kinds @ theta))
        grad = kinds.T @ (good * (1 - share) - bad * share) - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta


def constrained(labels: np.ndarray, odds: np.ndarray, sizes: np.ndarray, quality: int, share: float = KEEP_SHARE) -> np.ndarray:
    """labels with the least certain lines turned until the share of words in content lines is what the document's label says."""
    labels = labels.copy()
    content, total = int((labels * sizes).sum()), int(sizes.sum())
    for k in np.argsort(-odds if quality else odds, kind="stable").tolist():
        if (content >= share * total) == bool(quality):
            break
        if labels[k] != quality:
            labels[k] = quality
            content += int(sizes[k]) if quality else -int(sizes[k])
    return labels


def fitted(pages: list[tuple[np.ndarray, np.ndarray, int]]) -> Field:
    """The field from pages of (features of the lines, words of the lines, quality)."""
    if not pages:
        return Field()
    field = Field(line_odds(pages))
    weak = [constrained((x @ field.weights >= 0).astype(int), x @ field.weights, sizes, q) for x, sizes, q in pages]
    field = Field.trained([(x, y) for (x, _, _), y in zip(pages, weak, strict=True)], rounds=80)
    weak = [constrained(np.array(field.viterbi(x)), x @ field.weights, sizes, q) for x, sizes, q in pages]
    return Field.trained([(x, y) for (x, _, _), y in zip(pages, weak, strict=True)], rounds=70, start=field)


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Field:
    """The field from a sample of labelled documents, bounded in rows and in characters a row."""
    marked = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    drawn = marked.orderBy(F.xxhash64(F.col("doc_id"), F.lit("quality")), "doc_id", "quality").limit(most)
    texts = docs.select("doc_id", "text").where(F.length("text").between(1, TRAIN_CHARS))
    rows = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "quality", "text").limit(2 * most).collect()  # drawn is at most `most` rows
    pages = []
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["quality"], r["text"])):
        _, _, hit = base_counts(r["text"])
        x, sizes = line_features(r["text"], hit)
        if len(x):
            pages.append((x, sizes, r["quality"]))
    return fitted(pages)


def _judge(field: Field, keep_share: float):
    def run(source):
        for batch in source:
            for piece in slices(batch):
                rows = []
                for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    text = text or ""
                    counts, _, hit = base_counts(text)
                    x, sizes = line_features(text, hit)
                    good = np.array(field.viterbi(x) if len(x) else [], np.int64)
                    share = float((good * sizes).sum() / sizes.sum()) if len(x) else 0.0
                    failed = base_failed(counts)
                    rows.append((doc_id, *(counts[c] for c in COUNTS), failed, not failed and share >= keep_share, share, int(good.sum())))
                columns = list(zip(*rows, strict=True)) or [[] for _ in _OUT]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _OUT, strict=True)], schema=_OUT)

    return run


def judge(docs: DataFrame, field: Field, keep_share: float = KEEP_SHARE) -> DataFrame:
    return small_batches(docs).select("doc_id", "text").mapInArrow(_judge(field, keep_share), OUT_DDL)


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns the field from labels, then judges every row of docs."""
    return judge(docs, learn(docs, labels))
