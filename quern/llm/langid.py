"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (one to three letters,
words padded by a gap) in order of frequency. A document's own list is compared to each
profile by the out-of-place distance: for each of its n-grams the difference of the two
ranks, or the profile's length if the profile lacks it. The nearest language wins.

Profiles are learnt from at most about `per_language` documents of each language, drawn by a
hash of the id among rows of the learning folds; every document is judged by its whole text.

Defined cases: a null text, or one without a letter, is `und` with score 0. Equal distances
go to the language that comes first in the alphabet. A null lang is never learnt from. With
nothing to learn from, every document is `und`. A null doc_id is not held out and not learnt
from. Repeated rows each give a row. Other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import held_out, settle, slices, small_batches

PROFILE = 300
PER_LANGUAGE = 1500
#: Values of lang whose counts may be broadcast.
BROADCAST_LANGS = 10_000

_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
OUT_DDL = "doc_id long, held_out boolean, lang_pred string, score double"
_GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """True at each code point that is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as numbers, in ascending order, and their counts.

    An n-gram is a leading 1 and 21 bits for each letter; a gap is 0. Below U+0400 ten bits
    are enough, and 32-bit numbers are sorted several times as fast.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letters = np.where(_letters()[points], points, 0)
    keep = np.empty(len(letters), bool)
    if len(letters):
        keep[0] = True
        np.logical_or(letters[1:] != 0, letters[:-1] != 0, out=keep[1:])
    padded = np.concatenate(([0], letters[keep], [0]))
    bits, kind = (10, np.uint32) if not len(letters) or letters.max() < 1 << 10 else (21, np.uint64)
    c = padded.astype(kind)
    one = c[c != 0] | kind(1 << bits)
    two = (c[:-1] << kind(bits)) | c[1:]
    two = two[two != 0] | kind(1 << 2 * bits)
    three = (((c[:-2] << kind(bits)) | c[1:-1]) << kind(bits)) | c[2:]
    three = three[c[1:-1] != 0] | kind(1 << 3 * bits)
    every = np.sort(np.concatenate((one, two, three)))
    if not len(every):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    counts = np.diff(np.append(first, len(every)))
    return _widened(every[first]) if bits == 10 else every[first], counts


def _widened(packed: np.ndarray) -> np.ndarray:
    """Ten bits a letter to 21; the order stays."""
    p = packed.astype(np.uint64)
    low, mid, high = p & np.uint64(1023), (p >> np.uint64(10)) & np.uint64(1023), p >> np.uint64(20)
    one, two = p < np.uint64(1 << 20), (p >= np.uint64(1 << 20)) & (p < np.uint64(1 << 30))
    high = np.where(two | one, high, high & np.uint64(1023))
    mark = np.where(one, np.uint64(1 << 21), np.where(two, np.uint64(1 << 42), np.uint64(1 << 63)))
    body = np.where(one, low, np.where(two, (mid << np.uint64(21)) | low, (high << np.uint64(42)) | (mid << np.uint64(21)) | low))
    return body | mark


def top(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, ties in the order of their numbers."""
    return codes[np.argsort(-counts, kind="stable")[:most]]


class Profiles:
    """Ranks of each language's n-grams, as one table over all n-grams that occur."""

    def __init__(self, lists: dict[str, np.ndarray], most: int = PROFILE):
        self.langs, self.most = sorted(lists), most
        self.codes = np.unique(np.concatenate([lists[k] for k in self.langs])) if lists else np.empty(0, np.uint64)
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, lists[lang]), k] = np.arange(len(lists[lang]))

    def judge(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return "und", 0.0
        own = top(*grams(text), self.most)
        if not len(own):
            return "und", 0.0
        at = np.searchsorted(self.codes, own)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != own] = len(self.codes)
        ranks = self.ranks[at]
        far = np.where(ranks >= 0, np.abs(ranks - np.arange(len(own))[:, None]), self.most).sum(axis=0)
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (self.most * len(own)))


def _count_grams(source):
    for batch in source:
        sums: dict[str, tuple[list, list]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for into, values in zip(sums.setdefault(lang, ([], [])), grams(text or ""), strict=True):
                into.append(values)
        for lang, (codes, counts) in sums.items():
            found, at = np.unique(np.concatenate(codes), return_inverse=True)
            n = np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n)], schema=_GRAMS)


def learn(docs: DataFrame, most: int = PROFILE, per_language: int = PER_LANGUAGE) -> Profiles:
    """Profiles of the languages in the learning folds; what comes back is most rows a language."""
    rows = small_batches(docs).select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = settle(rows.groupBy("lang").agg(F.count("*").alias("size")))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_LANGS else sizes
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1 << 30)) / (1 << 30)
    drawn = rows.join(sizes, "lang").where(draw * F.col("size") < per_language)
    counted = drawn.select("lang", "text").mapInArrow(_count_grams, "lang string, gram long, n long")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.expr("gram < 0"), "gram")
    ranked = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    lists: dict[str, list] = {}
    for r in ranked.orderBy("lang", "rank").collect():
        lists.setdefault(r["lang"], []).append(r["gram"])
    return Profiles({k: np.array(v, np.int64).view(np.uint64) for k, v in lists.items()}, most)


def _judge(profiles: Profiles):
    def run(source):
        for batch in source:
            for piece in slices(batch):
                found = [profiles.judge(t) for t in piece.column(2).to_pylist()]
                langs, scores = zip(*found, strict=True) if found else ((), ())
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=_OUT)

    return run


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    return small_batches(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_judge(profiles), OUT_DDL)


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the learning folds of docs, then judges every row."""
    return predict(docs, learn(docs))
