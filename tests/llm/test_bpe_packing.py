import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import bpe, packing
from tests.conftest import SF

from .conftest import ODD

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


def _sha(b):
    return hashlib.sha256(b).hexdigest()


def _encoded(text):
    ids = bpe.encoder(RANKS, P.PATTERN).encode_ordinary(text or "")
    return len(ids), _sha(" ".join(map(str, ids)).encode()), _sha((text or "").encode())


def _check_bpe(docs, rows, **options):
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256, str(r.doc_id)) for r in bpe.encode_decode(docs, RANKS, P.PATTERN, **options).collect())
    assert got == sorted((*_encoded(t), str(d)) for d, t in rows)


def test_bpe_is_what_the_library_gives(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    _check_bpe(docs, [(r.doc_id, r.text) for r in docs.collect()], block_tokens=5000)


def test_bpe_odd_rows(odd):
    _check_bpe(odd, [(d, t) for d, t, *_ in ODD])


def test_bpe_of_rows_from_a_shuffle(spark):
    """Rows whose order a retried task may change are written before both passes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    _check_bpe(docs.repartition(5), [(r.doc_id, r.text) for r in docs.collect()], block_tokens=5000)


def test_bpe_notices_another_order(spark):
    import pyarrow as pa

    def passes(make, texts):
        return pa.Table.from_batches([b for b in make(iter([pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": texts})]))])

    class Task:
        partitionId = staticmethod(lambda: 0)

    import pyspark

    get = pyspark.TaskContext.get
    pyspark.TaskContext.get = classmethod(lambda cls: Task)
    try:
        codes, words, other = passes(bpe._codes(P.PATTERN, 99), ["a b", "c"]), passes(bpe._words(P.PATTERN, 99, 4), ["a b", "c"]), passes(bpe._words(P.PATTERN, 99, 4), ["c", "a b"])
    finally:
        pyspark.TaskContext.get = get
    back = lambda w: pa.Table.from_batches(list(bpe._encode_words(RANKS, P.PATTERN)(iter(w.to_batches()))))
    rows = bpe._reassemble(RANKS)(codes, back(words)).to_pylist()
    assert [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows] == [_encoded("a b"), _encoded("c")]
    with pytest.raises(RuntimeError):
        bpe._reassemble(RANKS)(codes, back(other))


def test_bpe_empty(make):
    assert bpe.encode_decode(make([]), RANKS, P.PATTERN).count() == 0


@settings(deadline=None)
@given(st.lists(st.integers(0, (1 << 28) - 1)))
def test_codes_round_trip(codes):
    packed, ends = bpe.pack_codes(np.array(codes, np.uint32))
    assert bpe.unpack_codes(packed).tolist() == codes and len(ends) == len(codes)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t'sltméß9.,!— \x1c"))
def test_fast_split_is_the_pattern(text):
    import regex

    assert bpe.splitter(P.PATTERN)(text) == regex.findall(P.PATTERN, text)


def test_common_pattern_is_the_given_one():
    assert bpe.COMMON_PATTERN == P.PATTERN


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcXYZ .,!|\néÉßİΣσé\x1c\xa0'st<|>9中"))
def test_word_ids_are_what_the_library_gives(tokenizer, text):
    own = packing.word_ids(WORDS)([text])[0]
    assert list(struct.unpack(f"<{len(own) // 4}I", own)) == tokenizer.encode(text, add_special_tokens=False).ids


def test_word_memory_is_bounded(tokenizer):
    """A worker that meets ever new words holds a bounded number of them, and encodes as before once it has dropped them."""
    own = packing.WordIds(WORDS)
    first = own(["some words, that come again"])
    for at in range(0, 760_000, 40_000):
        own([" ".join(f"{chr(97 + k % 26)}{k}" for k in range(at, at + 40_000))])
        assert len(own.known) <= 660_000 and len(own.parts) <= 660_000
    assert own(["some words, that come again"]) == first


def _check_packing(rows, pieces, tokenizer, window=2048):
    """Each id in one piece, windows gapless from 0 and within the window."""
    want = sorted((str(d), tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for d, t in rows)
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(str(p.doc_id), []).append(p)
    left = {}
    for d, ids in want:
        left.setdefault(d, []).append(ids)
    for d, own in by_doc.items():
        assert sum(p.length for p in own) == sum(map(len, left[d]))
        if len(left[d]) == 1:
            ids, at = left[d][0], 0
            for p in sorted(own, key=lambda p: p.start):
                part = ids[at : at + p.length]
                assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
                at += p.length
            assert at == len(ids)
    assert set(by_doc) == set(left)
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append(p)
    for own in windows.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return len(windows)


def test_packing(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = packing.pack(docs, WORDS).collect()
    n = _check_packing([(r.doc_id, r.text) for r in docs.collect()], pieces, tokenizer)
    assert n * 2048 < 1.02 * sum(p.length for p in pieces) + 2048


def test_packing_odd_rows(odd, tokenizer):
    _check_packing([(d, t) for d, t, *_ in ODD], packing.pack(odd, WORDS, open_windows=2).collect(), tokenizer)


def test_packing_empty(make):
    assert packing.pack(make([]), WORDS).count() == 0


def test_packing_many_partitions(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(9)
    pieces = packing.pack(docs, WORDS, open_windows=3, merge_width=4).collect()
    _check_packing([(r.doc_id, r.text) for r in docs.collect()], pieces, tokenizer)


@settings(deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_packer_loses_nothing(sizes):
    out = []
    packer = packing.Packer(lambda pieces, fill: out.append((pieces, fill)), window=100, open_windows=3, min_piece=5)
    for k, n in enumerate(sizes):
        packer.add(k, 0, struct.pack(f"<{n}I", *range(n)), n)
    out += [(pieces, fill) for fill, pieces in packer.leftovers()]
    assert all(fill <= 100 and fill == sum(len(p[2]) // 4 for p in pieces) for pieces, fill in out)
    for k, n in enumerate(sizes):
        own = sorted((p[1], p[2]) for pieces, _ in out for p in pieces if p[0] == k)
        assert b"".join(b for _, b in own) == struct.pack(f"<{n}I", *range(n))
