"""Exact removal of repeated byte strings by a distributed merge sort of suffixes.

Every byte covered by a `width`-byte string that also starts elsewhere is removed. Sorting all
suffixes would move each byte hundreds of times, so suffixes are sorted where it can matter:

1. Anchors. Every window of `width` bytes chooses one of its first SPAN positions by the least
   hash of the 8 bytes there, so equal windows choose alike. Neighbouring windows mostly share
   their anchor; the windows of an anchor all hold the same `core` bytes from it on.
2. Anchors are shuffled by a hash of the core, in buckets of packed records. An anchor whose
   core occurs once has no repeated window. Anchors whose whole neighbourhood (all bytes of
   all their windows) is equal are repeated throughout; equal ones of a few MB of text are
   sent once, the others as what they cover. What remains are anchors with equal cores and
   different neighbourhoods: the edges of repeated passages.
3. The suffixes from these anchors are sorted: each task sorts a run, front-codes it (length
   of the prefix shared with the suffix before, and the rest), and sends its part of each
   range. A range merges its runs with a loser tree that keeps the shared prefix of every
   loser with its winner, so no byte known to be equal is compared again. Suffixes that share
   a core now lie together. Their windows are equal where the merged order's common prefixes
   reach the window's end and the bytes before the anchors, ordered from there, are the same.
4. Cores with more than HOT_EDGES neighbourhoods (the footer of a large site) would all meet
   in one range. Their windows are dealt by two hashes of the whole window instead: counts are
   summed before they are shuffled, and windows met twice are joined back. Cores that a sample
   finds on so many pages that their records would fill a task go there at once.
5. The intervals found are united in each text and cut out.

Texts that occur more than once are removed whole (if they have `width` bytes) and sorted once.

Defined cases: a null text is the empty text. Texts shorter than `width` lose nothing. Each
row counts, repeated rows too. A null doc_id is kept. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.bpe import pack_codes, unpack_codes
from quern.llm.common import content_key, give_back, settle, small_batches

WIDTH = 400
#: Positions that a window chooses its anchor from; a power of two.
SPAN = 256
#: Bytes of text that go through the array code at once.
BUFFER = 1 << 19
#: Bytes of text whose anchors are packed together.
PACKED = 1 << 23
BUCKETS_EACH = 4
#: Suffixes of a run, and texts that the ranges are cut by.
RUN = 30_000
SAMPLE_TEXTS = 2000
SAMPLE_HEADS = 50_000
#: Neighbourhoods of one core that meet in one range, about 600 bytes each.
HOT_EDGES = 20_000
#: Anchors of one core, as a sample has it, that meet in one task, 31 bytes each; and how often the sample must hold it.
HOT_ANCHORS = 2_000_000
HOT_SEEN = 3
#: Windows found that a task holds at once.
WINDOWS = 1 << 19
#: Keys that may be broadcast, about 40 bytes each.
BROADCAST_KEYS = 200_000

_RECORD = np.dtype([("core", "<u8"), ("whole", "<u8"), ("key", "V16"), ("low", "<u4"), ("wide", "u1"), ("at", "u1"), ("kind", "u1")])
_POSTING, _COVER, _HOT = 0, 1, 2


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte (two sets), powers of an odd base, and their inverses modulo 2**64."""
    rng = np.random.default_rng(17)
    base = 0x9E3779B97F4A7C15
    size = BUFFER + 4 * WIDTH
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, base, np.uint64))), dtype=np.uint64)
        back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64))), dtype=np.uint64)
    return rng.integers(0, 1 << 64, (2, 256), np.uint64), power, back


class Hashes:
    """Hashes of any stretch of a buffer, in two independent sets."""

    def __init__(self, buf: np.ndarray):
        numbers, power, self.back = _tables()
        self.sums = []
        for own in numbers:
            s = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum(own[buf] * power[: len(buf)], out=s[1:])
            self.sums.append(s)

    def of(self, low: np.ndarray, high: np.ndarray, which: int = 0) -> np.ndarray:
        s = self.sums[which]
        x = (s[high] - s[low]) * self.back[low]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def anchors(buf: np.ndarray, pieces: list[tuple[int, int]], width: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor) of each stretch of windows with one anchor; pieces are texts' ends in buf."""
    none = np.empty(0, np.int64)
    if len(buf) < max(width, span + 8):
        return none, none, none
    grams = np.lib.stride_tricks.as_strided(buf, (len(buf) - 7, 8), (1, 1))
    v = np.ascontiguousarray(grams).view("<u8").ravel() * np.uint64(0xC2B2AE3D27D4EB4F)
    v ^= v >> np.uint64(29)
    v *= np.uint64(0x165667B19E3779F9)
    v = (v & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(v), dtype=np.uint64)
    step = 1
    while step < span:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    starts = [np.arange(a, b - width + 1) for a, b in pieces if b - a >= width]
    if not starts:
        return none, none, none
    s = np.concatenate(starts)
    p = (v[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate(([True], (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    return s[first], s[last], p[first]


def _buffers(texts: list[bytes], width: int):
    """(buffer, [(text, its offset, begin, end)]): texts side by side, long ones in overlapping pieces."""
    parts, places, size = [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(len(text) - width + 1, 0), BUFFER - width):
            part = text[at : at + BUFFER - 1]
            if size + len(part) > BUFFER and parts:
                yield np.frombuffer(b"".join(parts), np.uint8), places
                parts, places, size = [], [], 0
            parts.append(part)
            places.append((k, at, size, size + len(part)))
            size += len(part)
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), places


def records(keys: list[bytes], texts: list[bytes], width: int = WIDTH, span: int = SPAN) -> np.ndarray:
    """A posting for each anchor; of those with equal neighbourhoods one posting, and covers for all."""
    core = width - span + 1
    found = [np.empty(0, _RECORD)]
    names = np.array(keys, "V16") if keys else np.empty(0, "V16")
    for buf, places in _buffers(texts, width):
        low, high, at = anchors(buf, [p[2:] for p in places], width, span)
        if not len(low):
            continue
        h = Hashes(buf)
        place = np.searchsorted(np.array([p[2] for p in places]), low, side="right") - 1
        own = np.empty(len(low), _RECORD)
        own["core"] = h.of(at, at + core)
        own["whole"] = h.of(low, high + width) ^ (h.of(low, high + width, 1) >> np.uint64(1)) ^ (at - low).astype(np.uint64)
        own["key"] = names[np.array([p[0] for p in places])[place]]
        own["low"] = low - np.array([p[2] - p[1] for p in places])[place]
        own["wide"], own["at"], own["kind"] = high - low, at - low, _POSTING
        found.append(own)
    own = np.concatenate(found)
    own = own[np.lexsort((own["whole"], own["core"]))]
    same = (own["core"][1:] == own["core"][:-1]) & (own["whole"][1:] == own["whole"][:-1])
    covers = own[np.unique(np.concatenate((np.flatnonzero(same), np.flatnonzero(same) + 1)))].copy()
    covers["kind"] = _COVER
    return np.concatenate((own[np.concatenate(([True], ~same))[: len(own)]], covers))


def _within(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values are in `some`, an ascending array."""
    if not len(some):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def _post(width: int, span: int, buckets: int, hot: np.ndarray):
    """Packed records by bucket. Those of hot cores are dealt by their texts, to buckets of their own."""
    schema = pa.schema([("bucket", pa.int32()), ("records", pa.binary())])

    def packed(keys, texts):
        own = records(keys, texts, width, span)
        bucket = (own["core"] % np.uint64(buckets)).astype(np.int32)
        spread = _within(own["core"], hot)
        bucket[spread] = buckets + (np.ascontiguousarray(own["key"][spread]).view("<u8").reshape(-1, 2)[:, 0] % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        own, bucket = own[order], bucket[order]
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(own) else np.empty(0, np.int64)
        cuts = np.append(first, len(own)).tolist()
        return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array([own[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], schema=schema)

    def run(source):
        keys, texts, size = [], [], 0
        for batch in source:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                keys.append(key)
                texts.append(raw)
                size += len(raw)
                if size >= PACKED:
                    yield packed(keys, texts)
                    keys, texts, size = [], [], 0
        if keys:
            yield packed(keys, texts)
        keys, texts = [], []
        give_back()

    return run


def judged(own: np.ndarray, most: int) -> np.ndarray:
    """Of a bucket's records: covers, and one posting for each of the neighbourhoods that share a core; hot if they are more than `most`."""
    covers, posts = own[own["kind"] == _COVER], own[own["kind"] == _POSTING]
    if not len(posts):
        return covers
    posts = posts[np.lexsort((posts["low"], np.ascontiguousarray(posts["key"]).view("<u8").reshape(-1, 2)[:, 0], posts["whole"], posts["core"]))]
    new_core = np.concatenate(([True], posts["core"][1:] != posts["core"][:-1]))
    new_class = new_core | np.concatenate(([True], posts["whole"][1:] != posts["whole"][:-1]))
    class_of, core_of = np.cumsum(new_class) - 1, np.cumsum(new_core) - 1
    twice = np.bincount(class_of)[class_of] > 1
    classes = np.bincount(core_of[new_class])[core_of]
    again = posts[twice].copy()
    again["kind"] = _COVER
    posts["kind"][classes > most] = _HOT
    return np.concatenate((covers, again, posts[new_class & (classes > 1)]))


_FOUND_DDL = "key binary, low long, high long, at long, kind int"
_FOUND = pa.schema([("key", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("at", pa.int64()), ("kind", pa.int32())])


def _judge(buckets: int, most: int):
    """Rows come sorted by bucket; those from `buckets` on are of hot cores and aren't put together. high: the last window of the stretch."""

    def rows(own: np.ndarray):
        keys = own["key"].tobytes()
        low = own["low"].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([keys[k : k + 16] for k in range(0, len(keys), 16)], pa.binary()), pa.array(low), pa.array(low + own["wide"]), pa.array(low + own["at"]), pa.array(own["kind"].astype(np.int32))], schema=_FOUND)

    def run(source):
        last, parts = None, []
        for batch in source:
            for bucket, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket >= buckets:
                    own = np.frombuffer(packed, _RECORD).copy()
                    own["kind"][own["kind"] == _POSTING] = _HOT
                    yield rows(own)
                    continue
                if bucket != last and parts:
                    yield rows(judged(np.frombuffer(b"".join(parts), _RECORD), most))
                    parts = []
                last = bucket
                parts.append(packed)
        if parts:
            yield rows(judged(np.frombuffer(b"".join(parts), _RECORD), most))

    return run


_WINDOW_DDL = "one long, two long, key binary, low long"
_WINDOW = pa.schema([("one", pa.int64()), ("two", pa.int64()), ("key", pa.binary()), ("low", pa.int64())])


def _hot_windows(width: int):
    """Two hashes of each window of the stretches in `places`."""

    def run(source):
        for batch in source:
            for key, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (text or "").encode()
                for p in places:
                    h = Hashes(np.frombuffer(raw[p["low"] : p["high"] + width], np.uint8))
                    at = np.arange(p["high"] - p["low"] + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(h.of(at, at + width).view(np.int64)), pa.array(h.of(at, at + width, 1).view(np.int64)), pa.array([key] * len(at), pa.binary()), pa.array(at + p["low"])], schema=_WINDOW)

    return run


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix; the first `known` bytes are equal."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (differ.bit_length() + 7) // 8


def front_coded(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    prefixes = [0, *(shared(a, b) for a, b in zip(suffixes, suffixes[1:], strict=False))][: len(suffixes)]
    return prefixes, [s[n:] for s, n in zip(suffixes, prefixes, strict=True)]


class LoserTree:
    """Merges sorted front-coded runs; yields (run, place in run, suffix, prefix shared with the one before).

    Each contender carries the length of its common prefix with the last winner it met. A
    longer one is the smaller suffix, unseen; only equal ones are compared, from there on.
    """

    def __init__(self, runs: list[tuple[list[int], list[bytes]]]):
        self.runs = runs
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.place = [-1] * self.size
        self.now: list[bytes | None] = [None] * self.size
        self.known = [0] * self.size
        self.losers = [0] * self.size

    def _advance(self, run: int) -> None:
        self.place[run] += 1
        k = self.place[run]
        prefixes, rests = self.runs[run]
        if k == len(rests):
            self.now[run] = None
        else:
            self.known[run] = prefixes[k]
            self.now[run] = (self.now[run][: prefixes[k]] if k else b"") + rests[k]

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs' suffixes, ties to the earlier run."""
        x, y = self.now[a], self.now[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if self.known[a] != self.known[b]:
            return (a, b) if self.known[a] > self.known[b] else (b, a)
        n = shared(x, y, self.known[a])
        first = len(x) == n and (len(y) > n or a < b) or len(x) > n and len(y) > n and x[n] < y[n]
        winner, loser = (a, b) if first else (b, a)
        self.known[loser] = n
        return winner, loser

    def __iter__(self):
        for run in range(len(self.runs)):
            self._advance(run)
        best = list(range(self.size))
        node = self.size
        while node > 1:
            node //= 2
            won = []
            for k in range(node):
                w, self.losers[node + k] = self._play(best[2 * k], best[2 * k + 1])
                won.append(w)
            best = won
        winner = best[0]
        while self.now[winner] is not None:
            yield winner, self.place[winner], self.now[winner], self.known[winner]
            self._advance(winner)
            node = (winner + self.size) // 2
            while node:
                winner, self.losers[node] = self._play(winner, self.losers[node])
                node //= 2


_RUN_DDL = "range int, prefixes binary, sizes binary, rests binary, left_sizes binary, lefts binary, keys binary, places binary"
_RUN = pa.schema([("range", pa.int32())] + [(c, pa.binary()) for c in ("prefixes", "sizes", "rests", "left_sizes", "lefts", "keys", "places")])


def _runs(splitters: list[bytes], width: int):
    """Sorted, front-coded runs of the suffixes from anchors, cut at the splitters."""

    def rows(items: list[tuple]):
        items.sort(key=lambda x: (x[0], x[1], x[2]))
        ranges = [bisect_right(splitters, x[0]) for x in items]
        first = [k for k in range(len(items)) if k == 0 or ranges[k] != ranges[k - 1]]
        out = []
        for a, b in zip(first, [*first[1:], len(items)], strict=True):
            own = items[a:b]
            prefixes, rests = front_coded([x[0] for x in own])
            code = lambda values: pack_codes(np.array(values, np.uint32))[0]
            out.append((ranges[a], code(prefixes), code([len(r) for r in rests]), b"".join(rests), code([len(x[4]) for x in own]), b"".join([x[4] for x in own]), b"".join([x[1] for x in own]), np.array([(x[2], x[3]) for x in own], np.int64).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _RUN, strict=True)], schema=_RUN)

    def run(source):
        items = []
        for batch in source:
            for key, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (text or "").encode()
                items += [(raw[p["at"] : p["high"] + width], key, p["low"], p["high"], raw[p["low"] : p["at"]]) for p in places]
                if len(items) >= RUN:
                    yield rows(items)
                    items = []
        if items:
            yield rows(items)

    return run


def _split(packed: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=False)]


def repeated_windows(members: list[tuple[int, int, bytes, bytes, int]], width: int, most: int = WINDOWS, known: list[int] | None = None) -> list[tuple[int, int, int]]:
    """members: (group, number, left bytes, suffix, windows), groups together. (number, first window, last window) for windows met twice in a group.

    `known`: the prefix each suffix shares with the one before in its group, -1 at a group's
    first; without it, the suffixes are sorted here. About `most` windows found are held at once.
    """
    if known is None:
        members = sorted(members, key=lambda m: (m[0], m[3]))
        known = [-1, *(shared(x[3], y[3]) if x[0] == y[0] else -1 for x, y in zip(members, members[1:], strict=False))]
    found: list[tuple[int, int, int]] = []
    begin = size = 0
    for k, m in enumerate(members):
        if size > most and m[0] != members[k - 1][0]:
            found += _repeated(members[begin:k], known[begin:k], width, most)
            begin, size = k, 0
        size += m[4]
    return found + (_repeated(members[begin:], known[begin:], width, most) if members else [])


def _repeated(members: list[tuple], known: list[int], width: int, most: int) -> list[tuple[int, int, int]]:
    """As repeated_windows, for members in the order of their suffixes.

    Equal windows lie equally far before their anchors. Those `far` bytes before are equal where
    the suffixes share the window's other bytes, which the common prefixes tell of neighbours
    in the order, and the last `far` bytes of the lefts are equal, told by an order of their own.
    """
    n = len(members)
    number, left, windows = np.array([m[1] for m in members]), np.array([len(m[2]) for m in members]), np.array([m[4] for m in members])
    ahead = np.array(known)
    turned = [m[2][::-1] for m in members]
    order = sorted(range(n), key=lambda k: (members[k][0], turned[k]))
    behind = np.array([-1, *(shared(turned[x], turned[y]) if members[x][0] == members[y][0] else -1 for x, y in zip(order, order[1:], strict=False))])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    found: list[tuple[int, int, int]] = []
    owners, firsts, size = [], [], 0
    for far in range(int(left.max()) + 1):
        own = np.flatnonzero((left >= far) & (left - far < windows))
        same = np.cumsum(ahead < width - far)[own] * (n + 1) + np.cumsum(behind < far)[place[own]]
        _, kind, times = np.unique(same, return_inverse=True, return_counts=True)
        own = own[times[kind] > 1]
        owners.append(own)
        firsts.append(left[own] - far)
        size += len(own)
        if size > most:
            found += _stretches(np.concatenate(owners), np.concatenate(firsts), number)
            owners, firsts, size = [], [], 0
    return found + (_stretches(np.concatenate(owners), np.concatenate(firsts), number) if size else [])


def _stretches(owner: np.ndarray, rel: np.ndarray, number: np.ndarray) -> list[tuple[int, int, int]]:
    """(number, first window, last window) of each row of windows without a gap."""
    order = np.lexsort((rel, owner))
    owner, rel = owner[order], rel[order]
    begin = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (rel[1:] != rel[:-1] + 1))))
    return list(zip(number[owner[begin]].tolist(), rel[begin].tolist(), rel[np.append(begin[1:], len(rel)) - 1].tolist(), strict=True))


def _merge(width: int, span: int):
    core = width - span + 1

    def run(table: pa.Table) -> pa.Table:
        runs, lefts, keys, places = [], [], [], []
        for r in table.sort_by("keys").to_pylist():
            runs.append((unpack_codes(r["prefixes"]).tolist(), _split(r["rests"], unpack_codes(r["sizes"]))))
            lefts.append(_split(r["lefts"], unpack_codes(r["left_sizes"])))
            keys.append(r["keys"])
            places.append(np.frombuffer(r["places"], np.int64).reshape(-1, 2))
        members, names, prefixes, group, last = [], [], [], -1, None
        for run_no, k, suffix, known in LoserTree(runs):
            own = (lefts[run_no][k], suffix, places[run_no][k], keys[run_no][16 * k : 16 * k + 16])
            if last is not None and known >= core:
                for m in [last, own] if last[4] is None else [own]:
                    if m is last:
                        group += 1
                    low, high = m[2].tolist()
                    members.append((group, len(names), m[0], m[1], high - low + 1))
                    prefixes.append(-1 if m is last else known)
                    names.append((m[3], low))
                last = (*own, group)
            else:
                last = (*own, None)
        found = [(names[n][0], names[n][1] + a, names[n][1] + b, 0, _COVER) for n, a, b in repeated_windows(members, width, known=prefixes)]
        columns = list(zip(*found, strict=True)) or [[] for _ in _FOUND]
        del runs, lefts, members, names, prefixes, found
        give_back()
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _FOUND, strict=True)], schema=_FOUND)

    return run


def united(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open intervals, ascending and apart."""
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_CUT_DDL = "key binary, n_removed long, n_spans long, kept_sha256 string"
_CUT = pa.schema([("key", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _cut_out(width: int):
    def run(source):
        for batch in source:
            rows = []
            for key, text, intervals in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (text or "").encode()
                spans = united([(i["low"], i["high"] + width) for i in intervals])
                kept = b"".join([raw[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(raw)], strict=True)])
                rows.append((key, len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[] for _ in _CUT]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _CUT, strict=True)], schema=_CUT)

    return run


def _drawn(width: int, span: int):
    """The heads of the suffixes at the anchors of some texts, and the hashes of their cores."""
    core = width - span + 1

    def run(source):
        for batch in source:
            for (text,) in zip(batch.column(0).to_pylist(), strict=True):
                heads, cores = [], []
                for buf, places in _buffers([(text or "").encode()], width):
                    raw, at = buf.tobytes(), anchors(buf, [x[2:] for x in places], width, span)[2]
                    heads += [raw[p : p + 32] for p in at.tolist()]
                    cores.append(Hashes(buf).of(at, at + core).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary()), pa.array(np.concatenate([*cores, np.empty(0, np.int64)]))], names=["head", "core"])

    return run


def sampled(texts: DataFrame, total: int, ranges: int, width: int, span: int) -> tuple[list[bytes], np.ndarray]:
    """Bounds of ranges with about as many anchors each, and cores of so many anchors that a task should not hold them, from a bounded sample.

    Neither changes a result: bounds only balance the work, and hot cores are only treated another way.
    """
    share = min(1.0, SAMPLE_TEXTS / max(total, 1))
    drawn = texts.where(F.pmod(F.xxhash64("key", F.lit("suffixes")), F.lit(1 << 30)) < int((1 << 30) * share)).select("text")
    drawn = settle(drawn.mapInArrow(_drawn(width, span), "head binary, core long"))
    heads = sorted(r["head"] for r in drawn.select("head").orderBy(F.xxhash64("head"), "head").limit(SAMPLE_HEADS).collect())
    bounds = sorted({bytes(heads[k * len(heads) // ranges]) for k in range(1, ranges)}) if heads else []
    counts = drawn.groupBy("core").agg(F.count("*").alias("n")).where((F.col("n") >= HOT_SEEN) & (F.col("n") >= HOT_ANCHORS * share))
    return bounds, np.sort(np.array([r["core"] for r in counts.orderBy(F.desc("n"), "core").limit(SAMPLE_HEADS).collect()], np.int64).view(np.uint64))


def remove(docs: DataFrame, width: int = WIDTH, span: int = SPAN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs."""
    spark = docs.sparkSession
    rows = small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", content_key(F.col("text")))
    narrow = settle(rows.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256")))
    copies = settle(narrow.groupBy("key").agg(F.count("*").alias("copies"), F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("rep")).where("copies > 1"))

    def listed(keys: DataFrame, few: bool | None = None) -> DataFrame:
        few = keys.count() <= BROADCAST_KEYS if few is None else few
        return F.broadcast(keys) if few else keys

    spare = narrow.join(listed(copies), "key").where(F.coalesce("doc_id", F.lit(-(1 << 63))) > F.col("rep")).select("key", F.col("doc_id").alias("spare_id"))
    spare = settle(spare)
    texts = rows.join(listed(spare), (rows["key"] == spare["key"]) & (rows["doc_id"] == spare["spare_id"]), "left_anti").select("key", "text")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS_EACH * parts
    bounds, hot = sampled(texts, narrow.count(), 2 * parts, width, span)
    posted = texts.mapInArrow(_post(width, span, buckets, hot), "bucket int, records binary")
    found = settle(posted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_judge(buckets, HOT_EDGES), _FOUND_DDL))

    def with_places(kind: int) -> DataFrame:
        own = found.where(F.col("kind") == kind)
        edges = own.groupBy("key").agg(F.collect_list(F.struct("low", "high", "at")).alias("places"))
        some = rows.select("key", "text").join(listed(own.select("key").distinct()), "key", "left_semi").dropDuplicates(["key"])
        return some.join(edges, "key").select("key", "text", "places")

    runs = with_places(_POSTING).mapInArrow(_runs(bounds, width), _RUN_DDL)
    merged = settle(runs.groupBy("range").applyInArrow(_merge(width, span), _FOUND_DDL))
    if not found.where(F.col("kind") == _HOT).isEmpty():
        each = settle(with_places(_HOT).mapInArrow(_hot_windows(width), _WINDOW_DDL))
        twice = settle(each.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1").select("one", "two"))
        again = each.join(listed(twice), ["one", "two"], "left_semi")
        merged = merged.unionAll(again.select("key", "low", F.col("low").alias("high"), F.lit(0).cast("long").alias("at"), F.lit(_COVER).alias("kind")))

    covers = found.where(F.col("kind") == _COVER).unionAll(merged).join(listed(copies.select("key")), "key", "left_anti")
    covers = settle(covers.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("intervals")))
    hit = rows.select("key", "text").join(listed(covers.select("key")), "key", "left_semi")
    cut = settle(hit.join(covers, "key").select("key", "text", "intervals").mapInArrow(_cut_out(width), _CUT_DDL))
    whole = F.col("copies").isNotNull() & (F.col("n_bytes") >= width)
    return narrow.join(copies.select("key", "copies"), "key", "left").join(cut, "key", "left").select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )
