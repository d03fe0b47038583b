"""Bounded-space online packing of token ids into fixed windows.

Each scan partition keeps `open_windows` windows. A document's ids are cut into full
windows and a rest; the rest goes to the open window that it fits most tightly. If it fits
none, the fullest is topped up with the head of the rest (if the gap is at least
`min_piece` ids) and emitted. Windows still open at a partition's end are merged with those
of `merge_width` neighbouring partitions by the same rule.

Defined cases: a null or empty text is the end id alone, one piece of length 1. Repeated
rows and ids are packed each on their own. A null doc_id is kept. An empty table gives no
pieces. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import MEMORIES, give_back, settle, slices, small_batches

WINDOW = 2048
END_ID = 1
OPEN_WINDOWS = 16
MIN_PIECE = 8
MERGE_WIDTH = 32
#: Distinct words, and parts of words, whose ids a Python worker remembers before it starts afresh:
#: more memory for a worker, less time. Ids don't depend on it.
CACHE_WORDS = 600_000
CACHE_PARTS = 500_000

COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
_PIECES = pa.schema([(c, pa.int64()) for c in COLUMNS] + [("part", pa.int64()), ("ids", pa.binary())])
PIECES_DDL = ", ".join(f"{c} long" for c in COLUMNS) + ", part long, ids binary"

#: Spaces beyond ASCII, and controls that Python splits at but the tokenizer does not.
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Latin letters that have one lower-case form, then plain marks.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!|]*)")
_CHUNK = re.compile(r"[^ \t\n\r\x0b\x0c]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class WordIds:
    """Ids of a text as little-endian 32-bit bytes, each distinct word encoded once.

    The tokenizer drops white space and never merges across it, so the ids of a text are
    those of its words in a row.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.merges = self.model.tokenize
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _encode(self, part: str) -> bytes:
        """Ids of lower-case letters or of marks: one pre-token, so the merges alone are left to do."""
        shown = "".join(map(self.letters.__getitem__, part.encode()))
        ids = b"".join([t.id.to_bytes(4, "little") for t in self.merges(shown)])
        self.parts[part] = ids
        return ids

    def _word(self, word: str) -> bytes:
        """Letters and the marks after them are split before any merge, and case is dropped."""
        if m := _PLAIN.fullmatch(word):
            core, marks = m[1].lower(), m[2]
            return (self.parts.get(core) or self._encode(core)) + (self.parts.get(marks) or self._encode(marks) if marks else b"")
        return b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(word, add_special_tokens=False).ids])

    def __call__(self, texts: list[str]) -> list[bytes]:
        words = [_CHUNK.findall(t) if _ODD_SPACE.search(t) else t.split() for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        if len(self.parts) > CACHE_PARTS:
            self.parts.clear()
        known = self.known
        for w in set().union(*words):
            if w not in known:
                known[w] = self._word(w)
        return [b"".join(map(known.__getitem__, ws)) for ws in words]


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One tokenizer and word memory for each Python worker."""
    return WordIds(path)


MEMORIES.append(word_ids.cache_clear)


class Packer:
    """Open windows of one partition. emit() gets (pieces of a window, its fill)."""

    def __init__(self, emit, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, min_piece: int = MIN_PIECE):
        self.emit, self.window, self.most, self.min_piece = emit, window, open_windows, min_piece
        self.open: list[list] = []  # [fill, pieces]

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        """ids: little-endian 32-bit, placed from `start` of its document on."""
        size = len(ids) // 4
        done = 0

        def piece(length: int) -> tuple:
            return doc_id, start + done, ids[4 * done : 4 * (done + length)], doc_tokens

        while size - done >= self.window:
            self.emit([piece(self.window)], self.window)
            done += self.window
        while done < size:
            rest = size - done
            fitting = [w for w in self.open if w[0] + rest <= self.window]
            if fitting:
                into, length = max(fitting, key=lambda w: w[0]), rest
            elif len(self.open) < self.most:
                into, length = [0, []], rest
                self.open.append(into)
            else:
                into = max(self.open, key=lambda w: w[0])
                length = self.window - into[0]
                if length < self.min_piece:
                    self._close(into)
                    continue
            into[1].append(piece(length))
            into[0] += length
            done += length
            if into[0] == self.window:
                self._close(into)

    def _close(self, window: list) -> None:
        self.open = [w for w in self.open if w is not window]
        self.emit(window[1], window[0])

    def leftovers(self) -> list[list]:
        left, self.open = self.open, []
        return left


class _Rows:
    """Collects pieces as rows and numbers the windows from `base` on."""

    def __init__(self, part: int, base: int):
        self.part, self.next, self.rows = part, base, []

    def emit(self, pieces: list[tuple], fill: int, keep_ids: bool = False) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            placed = (None, None) if keep_ids else (self.next, at)
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, *placed, self.part, ids if keep_ids else None))
            at += n
        self.next += not keep_ids

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[] for _ in _PIECES]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _PIECES, strict=True)], schema=_PIECES)


def _pack_partition(tokenizer: str, window: int, open_windows: int, min_piece: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = word_ids(tokenizer)
        part = TaskContext.get().partitionId()
        rows = _Rows(part, part << 32)
        packer = Packer(rows.emit, window, open_windows, min_piece)
        end = END_ID.to_bytes(4, "little")
        for batch in source:
            for piece in slices(batch):
                ids = encode([t or "" for t in piece.column(1).to_pylist()])
                for doc_id, own in zip(piece.column(0).to_pylist(), ids, strict=True):
                    packer.add(doc_id, 0, own + end, len(own) // 4 + 1)
                yield rows.batch()
        for fill, pieces in packer.leftovers():
            rows.emit(pieces, fill, keep_ids=True)
        yield rows.batch()
        give_back()

    return run


def _merge_group(window: int, open_windows: int, min_piece: int, merge_width: int):
    def run(table: pa.Table) -> pa.Table:
        first = table.column("part")[0].as_py() // merge_width
        rows = _Rows(first, (1 << 62) + (first << 32))
        packer = Packer(rows.emit, window, open_windows, min_piece)
        left = sorted(table.to_pylist(), key=lambda r: (-r["length"], r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["part"], r["ids_crc32"]))
        for r in left:
            packer.add(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])
        for fill, pieces in packer.leftovers():
            rows.emit(pieces, fill)
        return pa.Table.from_batches([rows.batch()])

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, min_piece: int = MIN_PIECE, merge_width: int = MERGE_WIDTH) -> DataFrame:
    """Pieces (COLUMNS) of all documents; each id of a document lies in exactly one.

    The first pass runs where the rows are read, without a shuffle, and is written once, so
    that both its readers see the same windows. Only pieces of windows left open move: at
    most open_windows * window ids from a partition, merge_width partitions to a group.
    """
    placed = settle(small_batches(docs).select("doc_id", "text").mapInArrow(_pack_partition(tokenizer, window, open_windows, min_piece), PIECES_DDL))
    left = placed.where("ids IS NOT NULL")
    merged = left.groupBy(F.floor(F.col("part") / merge_width)).applyInArrow(_merge_group(window, open_windows, min_piece, merge_width), PIECES_DDL)
    return placed.where("ids IS NULL").select(*COLUMNS).unionByName(merged.select(*COLUMNS))
