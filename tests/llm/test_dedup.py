import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import graph, jaccard_join, suffix_dedup
from tests.conftest import SF

from .conftest import ODD


def _sets(rows):
    out = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        out.setdefault(d, []).append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def _components(sets):
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(p and q and 100 * len(p & q) >= 80 * len(p | q) for p in sets[a] for q in sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def _check_join(docs, rows):
    got = jaccard_join.join(docs).collect()
    assert len(got) == len(rows)
    sets = _sets(rows)
    want = _components({d: s for d, s in sets.items() if d is not None})
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.n_shingles in {len(s) for s in sets[r.doc_id]}


def _family(seed, n, edits):
    """Copies of a text with some words changed, beside texts that share a passage only."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    rows = []
    for k in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(120)] = word()
        rows.append((k, " ".join(own)))
    passage = base[:40]
    rows += [(n + k, " ".join(passage + [word() for _ in range(rng.randint(40, 200))])) for k in range(n)]
    return rows


def test_join_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    _check_join(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_join_of_a_family(spark):
    rows = _family(3, 60, 6)
    _check_join(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_join_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PART", 7)
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    rows = _family(4, 40, 7)
    _check_join(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_join_odd_rows(odd, make):
    _check_join(odd, [(d, t) for d, t, *_ in ODD])
    assert jaccard_join.join(make([])).count() == 0


def test_join_of_hot_tokens(spark, monkeypatch):
    """Tokens whose posters are put together nowhere lose no link."""
    monkeypatch.setattr(jaccard_join, "HOT_POSTERS", 1)
    rows = _family(7, 60, 6)
    _, hot = jaccard_join.frequent_tokens(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(hot) > 20
    _check_join(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_keep_one_with_names_of_its_own(make):
    docs = make([(k, f"one two three four five six {k // 2}", "en", "a") for k in range(6)]).withColumnsRenamed({"key": "_gone", "bits": "_twice", "n": "row", "bucket": "id", "label": "a.b"})
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 4]


def test_keep_one(odd):
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6, 7, 8] and ids.count(None) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60), min_size=1, max_size=40), min_size=2, max_size=40), st.randoms())
def test_trees_lose_no_pair(groups, rng):
    hashed = [np.unique(np.array([t * 0x9E3779B97F4A7C15 % (1 << 64) for t in g], np.uint64)) for g in groups]
    members = sorted(((len(h), k, rng.randint(0, 4) if rng.random() < 0.3 else 100 + k, jaccard_join.bitmap(h)) for k, h in enumerate(hashed)), key=lambda m: m[:2])
    root = jaccard_join.tree(members, fanout=3)
    got = {tuple(sorted(p)) for a in jaccard_join.traverse(root, root) for p in a.tolist()}
    label = {m[1]: m[2] for m in members}
    for a in range(len(groups)):
        for b in range(a + 1, len(groups)):
            if label[a] != label[b] and 100 * len(groups[a] & groups[b]) >= 80 * len(groups[a] | groups[b]):
                assert (a, b) in got


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _removed(rows, width):
    texts = [(d, (t or "").encode()) for d, t in rows]
    counts = Counter(x[i : i + width] for _, x in texts for i in range(len(x) - width + 1))
    out = []
    for d, x in texts:
        covered = bytearray(len(x))
        for i in range(len(x) - width + 1):
            if counts[x[i : i + width]] > 1:
                covered[i : i + width] = b"\1" * width
        kept = bytes(b for b, c in zip(x, covered, strict=True) if not c)
        spans = sum(1 for i in range(len(x)) if covered[i] and not (i and covered[i - 1]))
        out.append((str(d), len(x), len(x) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def _check_removal(docs, rows, width=400, span=256):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove(docs, width, span).collect())
    assert got == _removed(rows, width)


def test_removal_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    _check_removal(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_removal_odd_rows(odd, make):
    _check_removal(odd, [(d, t) for d, t, *_ in ODD])
    assert suffix_dedup.remove(make([])).count() == 0


def test_removal_of_passages(spark, monkeypatch):
    """Passages at all distances, in small windows so that every step is met; memory bounds lowered."""
    monkeypatch.setattr(suffix_dedup, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(suffix_dedup, "RUN", 50)
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abcd é") for _ in range(n))
    passages = [some(rng.randint(20, 90)) for _ in range(6)]
    rows = [(k, some(rng.randint(0, 60)) + "".join(rng.choice(passages) + some(rng.randint(0, 30)) for _ in range(rng.randint(0, 4)))) for k in range(120)]
    rows += [(200, "xy" * 80), (201, "z" * 100), (202, rows[3][1]), (202, rows[3][1])]
    _check_removal(spark.createDataFrame(rows, "doc_id long, text string"), rows, 40, 16)


def _site(n, own, seed=9):
    """Pages of a site: 3 in 10 end in one footer, after words of their own; some share more."""
    rng = random.Random(seed)
    some = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    footer = some(own)
    return [(k, some(rng.randint(0, own)) + (footer + some(rng.randint(0, 9)) if k % 10 < 3 else some(own))) for k in range(n)] + [(n + k, some(7) + footer[: own // 2 + 3 * k] + some(30)) for k in range(9)]


def test_removal_of_hot_cores(spark, monkeypatch):
    """One core in a third of the texts, whose neighbourhoods are too many for a range."""
    rows = _site(200, 90)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(suffix_dedup, "HOT_EDGES", 4)
    monkeypatch.setattr(suffix_dedup, "PACKED", 2000)
    _check_removal(docs, rows, 40, 16)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_KEYS", 0)
    _check_removal(docs, rows, 40, 16)


def test_removal_of_cores_hot_in_the_sample(spark, monkeypatch):
    rows = _site(120, 90)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(suffix_dedup, "HOT_ANCHORS", 5)
    monkeypatch.setattr(suffix_dedup, "PACKED", 2000)
    texts = docs.selectExpr("cast(cast(doc_id AS string) AS binary) AS key", "text")
    assert len(suffix_dedup.sampled(texts, len(rows), 4, 40, 16)[1]) > 1
    _check_removal(docs, rows, 40, 16)


def test_passages_on_both_sides_of_the_width(spark):
    """Passages of 399 bytes stay, however many words they have; of 400 and more they go."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for n in (390, 398, 399, 400, 401, 450):
        passage = " ".join(word() for _ in range(90))[:n]
        rows += [(len(rows) + k, f"{'xyz'[k]} {word()} " * 8 + f"{k}{passage}{k}" + f" {word()} {'uvw'[k]}" * 8) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _check_removal(docs, rows)
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove(docs).collect()}
    assert [got[3 * k] for k in range(6)] == [0, 0, 0, 400, 401, 450]


@settings(deadline=None)
@given(st.lists(st.lists(st.text("ab", max_size=8).map(str.encode), max_size=8), max_size=6))
def test_loser_tree_merges(runs):
    runs = [sorted(r) for r in runs]
    out = list(suffix_dedup.LoserTree([suffix_dedup.front_coded(r) for r in runs])) if runs else []
    assert [s for _, _, s, _ in out] == sorted(s for r in runs for s in r)
    assert all(runs[r][k] == s for r, k, s, _ in out)
    for (_, _, a, _), (_, _, b, n) in zip(out, out[1:], strict=False):
        assert n == suffix_dedup.shared(a, b)


@settings(deadline=None)
@given(st.binary(max_size=30), st.binary(max_size=30))
def test_shared(a, b):
    n = suffix_dedup.shared(a, b)
    assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


def test_windows_by_distance():
    """Few windows at a time find what all at once do."""
    rng = random.Random(2)
    members = []
    for k in range(30):
        left = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6)))
        members.append((k // 10, k, left, b"c" * 20 + bytes(rng.choice(b"ab") for _ in range(8)), len(left) + 1))
    few = sorted(x for x in suffix_dedup.repeated_windows(members, 24, 5))
    cover = lambda rows: {(n, w) for n, a, b in rows for w in range(a, b + 1)}
    assert cover(few) == cover(suffix_dedup.repeated_windows(members, 24, 1 << 20)) != set()


def test_windows_by_merged_order(monkeypatch):
    """What the merge knows decides which windows are equal, byte by byte; no hash is asked."""
    monkeypatch.setattr(suffix_dedup, "Hashes", None)
    rng = random.Random(8)
    members = []
    for k in range(60):
        left = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9)))
        members.append((k // 20, k, left, b"c" * 20 + bytes(rng.choice(b"ab") for _ in range(12)), len(left) + rng.randint(-3, 1)))
    members = [m for m in members if m[4] > 0]
    cut = lambda m, w: (m[0], len(m[2]) - w, (m[2] + m[3])[w : w + 24])
    times = Counter(cut(m, w) for m in members for w in range(m[4]))
    want = {(m[1], w) for m in members for w in range(m[4]) if times[cut(m, w)] > 1}
    for most in (5, 1 << 20):
        assert {(n, w) for n, a, b in suffix_dedup.repeated_windows(members, 24, most) for w in range(a, b + 1)} == want != set()


def _check_links(docs, rows):
    sets = _sets([r for r in rows if r[0] is not None])
    close = lambda p, q: p and q and 100 * len(p & q) >= 80 * len(p | q)
    want = {a: sum(any(close(p, q) for p in sets[a] for q in sets[b]) for b in sets if b != a) for a in sets}
    assert {r.doc_id: r.n_links for r in jaccard_join.link_counts(docs).collect()} == want
    return want


def test_links_between_connected_documents(make):
    """All links of a family count, also between documents that are connected by others."""
    rows = [*_family(3, 40, 6), (100, _family(3, 1, 0)[0][1]), (101, _family(3, 1, 0)[0][1]), (102, "alone"), (5, _family(4, 1, 0)[0][1]), (103, _family(4, 1, 0)[0][1])]
    want = _check_links(make([(d, t, "en", "a") for d, t in rows]), rows)
    assert max(want.values()) > 10 and len(set(want.values())) > 3 and want[102] == 0 and want[103] == 1


def test_links_odd_rows(odd):
    _check_links(odd, [(d, t) for d, t, *_ in ODD])
