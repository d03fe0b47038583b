"""Byte-level BPE by a global shuffle of distinct words.

1. Each scan partition is cut into blocks of bounded text. A block's pre-tokens are exploded
   with their positions: position i of a document holds the block's code of that word.
   Codes are numbered by first appearance and kept in one to four bytes.
2. The words of all blocks are shuffled by a hash of the word (a row holds a block's words of
   one bucket), so that equal words meet; each distinct word is encoded once and its ids are
   sent back to the blocks that hold it.
3. In a block, ids are joined to the positions, bytes to the ids by the token-byte table
   (fixed, about 50,000 rows), and the document is put together in order.

Only words of a block and codes move, never texts. Both passes over the table cut it into
blocks by the order of rows in a partition. A scan of files has the same order however often
a task is tried; any other input is written to the shared folder first and scanned from
there. Both passes hash the words of each block in their order, and a block whose hashes
differ raises an error, so that no order can give wrong ids.

Defined cases: a null text is the empty text: no ids, SHA-256 of nothing. Repeated rows each
give a row. A null doc_id is kept. An empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import settle, slices, small_batches

#: Pre-tokens in a block; bounds the memory of a Python worker.
BLOCK_TOKENS = 6_000_000

#: Buckets of words for each shuffle partition; bounds the words that a task holds at once.
BUCKETS_EACH = 8

_WORDS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("digest", pa.binary()), ("codes", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary())])
_CODES = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("codes", pa.binary())])
_BACK = pa.schema([("block", pa.int64()), ("digest", pa.binary()), ("codes", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
WORDS_DDL = "block long, bucket int, digest binary, codes binary, sizes binary, words binary"
CODES_DDL = "block long, row int, doc_id long, codes binary"
BACK_DDL = "block long, digest binary, codes binary, counts binary, ids binary"
OUT_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=token_bytes(path), special_tokens={})


def pack_codes(codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Packed bytes, and where each code ends. Codes below 2**28 as one to four bytes: seven bits each, the high bit says that more follow."""
    codes = codes.astype(np.uint32)
    width = 1 + (codes >= 1 << 7) + (codes >= 1 << 14) + (codes >= 1 << 21)
    ends = np.cumsum(width)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - width
    for k in range(4):
        has = width > k
        out[starts[has] + k] = ((codes[has] >> np.uint32(7 * k)) & 127) | ((width[has] > k + 1) << 7)
    return out.tobytes(), ends


def unpack_codes(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8)
    last = np.flatnonzero(raw < 128)
    starts = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    width = last - starts + 1
    codes = (raw[starts] & 127).astype(np.uint32)
    for k in range(1, 4):
        has = np.flatnonzero(width > k)
        codes[has] |= (raw[starts[has] + k] & 127).astype(np.uint32) << np.uint32(7 * k)
    return codes


def _cut(packed: bytes, ends: np.ndarray, cuts: list[int]) -> pa.Array:
    """Packed codes from each cut to the next, as rows."""
    at = np.concatenate(([0], ends))[cuts].tolist()
    return pa.array([packed[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())


#: The classes of the common pattern where a text has only ASCII and Latin letters.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_SPACE = " \\t\\n\\x0b\\x0c\\r"
_BEYOND = re.compile(f"[^\\x00-\\x7f{_LATIN}]").search
_PLAIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^{_SPACE}{_LATIN}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+").findall
#: The pattern that _PLAIN is the same as on such texts.
COMMON_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def splitter(pattern: str):
    """text -> pre-tokens. Texts of ASCII and Latin letters take a faster engine."""
    import regex

    slow = regex.compile(pattern).findall
    if pattern != COMMON_PATTERN:
        return slow
    return lambda text: slow(text) if _BEYOND(text) else _PLAIN(text)


class _Codes(dict):
    """Words numbered as they first appear, so that frequent ones get short codes."""

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        return code


def _blocks(source: Iterator[pa.RecordBatch], pattern: str, block_tokens: int):
    """(block, codes of its words, whether it ends, doc_ids, their words' codes) for each slice of rows."""
    from pyspark import TaskContext

    split = splitter(pattern)
    block = TaskContext.get().partitionId() << 24
    words, size, first = _Codes(), 0, 0
    for batch in source:
        for piece in slices(batch, 64):
            own = [list(map(words.__getitem__, split(t or ""))) for t in piece.column(1).to_pylist()]
            size += sum(map(len, own))
            ends = size >= block_tokens
            yield block, words, ends, first, piece.column(0), own
            first += len(own)
            if ends:
                block, words, size, first = block + 1, _Codes(), 0, 0
    if words:
        yield block, words, True, first, pa.array([], pa.int64()), []


def _digest(words: _Codes) -> bytes:
    """A hash of a block's words in the order of their codes."""
    h = hashlib.blake2b(digest_size=16)
    for w in words:
        raw = w.encode()
        h.update(len(raw).to_bytes(4, "little"))
        h.update(raw)
    return h.digest()


def _words(pattern: str, block_tokens: int, buckets: int):
    """The distinct words of each block, in a row for each bucket of words that it has any of."""

    def run(source):
        for block, words, ends, *_ in _blocks(source, pattern, block_tokens):
            if not ends:
                continue
            raw = [w.encode() for w in words]
            bucket = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw)) % np.uint32(buckets)
            order = np.argsort(bucket, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], bucket[order][1:] != bucket[order][:-1])))
            cuts = np.append(first, len(raw)).tolist()
            sizes, size_ends = pack_codes(np.fromiter(map(len, raw), np.uint32, len(raw))[order])
            codes, code_ends = pack_codes(order)
            raw = [raw[k] for k in order.tolist()]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(first), block)), pa.array(bucket[order][first].astype(np.int32)), pa.array([_digest(words)] * len(first), pa.binary()),
                _cut(codes, code_ends, cuts), _cut(sizes, size_ends, cuts), pa.array([b"".join(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
            ], schema=_WORDS)

    return run


def _codes(pattern: str, block_tokens: int):
    """A row for each document, and one of number -1 with the block's digest."""

    def run(source):
        for block, words, ends, first, ids, own in _blocks(source, pattern, block_tokens):
            if own:
                sizes = np.fromiter(map(len, own), np.int64, len(own))
                packed, at = pack_codes(np.fromiter(chain.from_iterable(own), np.uint32, int(sizes.sum())))
                cuts = [0, *np.cumsum(sizes).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(np.arange(first, first + len(own), dtype=np.int32)), ids, _cut(packed, at, cuts)], schema=_CODES)
            if ends and words:
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([-1], pa.int32()), pa.array([None], pa.int64()), pa.array([_digest(words)], pa.binary())], schema=_CODES)

    return run


def _encode_words(path: str, pattern: str):
    """Rows come sorted by bucket: each distinct word is met in one bucket and encoded once."""

    def run(source):
        encode = encoder(path, pattern)._core_bpe.encode_single_piece
        packed, ends = pack_codes(np.arange(max(token_bytes(path).values()) + 1))
        cut = [0, *ends.tolist()]
        each = [packed[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        last, known = None, {}
        for batch in source:
            counts, found = [], []
            for bucket, sizes, words in zip(*(batch.column(k).to_pylist() for k in (1, 4, 5)), strict=True):
                if bucket != last:
                    last, known = bucket, {}
                at, own = 0, []
                for size in unpack_codes(sizes).tolist():
                    word = words[at : at + size]
                    at += size
                    ids = known.get(word)
                    if ids is None:
                        tokens = encode(word)
                        ids = known[word] = (len(tokens), b"".join([each[i] for i in tokens]))
                    own.append(ids)
                counts.append(pack_codes(np.fromiter((n for n, _ in own), np.uint32, len(own)))[0])
                found.append(b"".join([ids for _, ids in own]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(counts, pa.binary()), pa.array(found, pa.binary())], schema=_BACK)

    return run


def _reassemble(path: str):
    """Joins ids and, by the token-byte table, bytes to the positions of a block's documents."""

    def run(codes: pa.Table, words: pa.Table) -> pa.Table:
        table = token_bytes(path)
        said_one, bytes_one = np.empty(max(table.values()) + 1, object), np.empty(max(table.values()) + 1, object)
        for token, rank in table.items():
            said_one[rank], bytes_one[rank] = str(rank), token
        documents = pc.greater_equal(codes.column("row"), 0)
        if set(codes.filter(pc.invert(documents)).column("codes").to_pylist()) != set(words.column("digest").to_pylist()):
            raise RuntimeError("two passes over the documents saw their rows in another order")
        codes = codes.filter(documents)
        code, count, ids = (unpack_codes(b"".join(words.column(c).to_pylist())) for c in ("codes", "counts", "ids"))
        ends = np.cumsum(count).tolist()
        starts = [0, *ends[:-1]]
        said, decoded, n = np.empty(len(code), object), np.empty(len(code), object), np.empty(len(code), np.int64)
        own = said_one[ids].tolist()
        said[code] = np.array([" ".join(own[a:b]) for a, b in zip(starts, ends, strict=False)] + [None], object)[:-1]
        own = bytes_one[ids].tolist()
        decoded[code] = np.array([b"".join(own[a:b]) for a, b in zip(starts, ends, strict=False)] + [None], object)[:-1]
        n[code] = count
        rows = []
        for doc_id, packed in zip(codes.column("doc_id").to_pylist(), codes.column("codes").to_pylist(), strict=True):
            at = unpack_codes(packed)
            rows.append((doc_id, int(n[at].sum()), hashlib.sha256(" ".join(said[at].tolist()).encode()).hexdigest(), hashlib.sha256(b"".join(decoded[at].tolist())).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [[] for _ in _OUT]
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _OUT, strict=True)], schema=_OUT)

    return run


def encode_decode(docs: DataFrame, ranks: str, pattern: str, block_tokens: int = BLOCK_TOKENS, scanned: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256.

    `scanned` says that docs is a plain scan of files; any other input is written first.
    """
    texts = small_batches(docs).select("doc_id", "text")
    texts = texts if scanned else settle(texts)
    buckets = BUCKETS_EACH * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    codes = texts.mapInArrow(_codes(pattern, block_tokens), CODES_DDL)
    words = texts.mapInArrow(_words(pattern, block_tokens, buckets), WORDS_DDL)
    encoded = words.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_encode_words(ranks, pattern), BACK_DDL)
    return codes.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(_reassemble(ranks), OUT_DDL)
