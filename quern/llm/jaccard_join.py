"""N-gram Jaccard join with signature trees.

A document is the set of its five-word shingles, as 64-bit hashes; two sets link when
100 * intersection >= 80 * union.

1. Documents with the same set become one representative.
2. Blocks: with tokens in one fixed order, two sets that link share a token among their
   first n - ceil(0.8 n) + 1. Representatives are posted under these tokens (rare ones first:
   tokens that a bounded sample finds frequent are moved to the end of the order, which keeps
   blocks small and cannot lose a pair). Tokens are shuffled by hash buckets; a token's
   posters are a block, and equal blocks become one. Tokens of which the sample expects more
   than HOT_POSTERS posters are dealt by their posters instead, and put together nowhere.
3. Stars: in each block every member is compared with the member that is in most blocks. The
   links found connect most copies of one text at once, by one comparison each.
4. Trees: signature trees find what is left. Nodes hold the OR of their members' token bitmaps
   and their range of sizes. Two nodes are traversed together and dropped when their sizes are
   too far apart, when all their members are connected already, or when the bits they share
   allow too small an overlap. A component that fills a tenth of a block is a hub: its tree is
   traversed once with all members outside it that share a block with it, and not in each
   block; a block has ten hubs at most. The rest of a block gets a tree of its own. Hubs,
   their guests and blocks are cut into parts, and each pair of parts is its own task.
5. Pairs that are left are verified on the whole sets, and components are found by rounds of
   joins.

join() gives connectivity only: pairs that are connected already are dropped unseen. links() and
link_counts() drop none, for all links and for the number of links of each document.

Defined cases: null texts and texts without words have the empty set, link with nothing, and
are their own component. Fewer than five words are one shingle. Rows that share a doc_id are
one document; a row with a null doc_id has no component. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import forget, give_back, settle, slices, small_batches
from quern.llm.graph import components

SHINGLE = 5
PERCENT = 80
#: Documents from which frequent tokens are learnt, and how many of these are kept.
SAMPLE_DOCS = 12_000
FREQUENT_AT = 4
MOST_FREQUENT = 100_000
#: Only hashes below this are counted: the first fifth of a set, by hash, holds few others.
SAMPLE_BELOW = np.uint64(3 << 61)
#: Members of a block that one task compares with each other.
PART = 1000
LEAF = 16
#: Members of one component that make it a hub of a block.
HUB = 8
#: Rows of ids that may be broadcast: 8 bytes each.
BROADCAST_IDS = 500_000
BUCKETS_EACH = 4
#: Posters of a token, as the sample has it, that are put together in one task: 16 bytes each.
HOT_POSTERS = 1_000_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z is lowered, only 20 and 09 to 0D split
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(SHINGLE, len(h))
    if not width:
        return h
    x = h[: len(h) - width + 1] * _MIX[0]
    for k in range(1, width):
        x = (x ^ (x >> np.uint64(29))) * _MIX[k] + h[k : len(h) - width + 1 + k]
    x ^= x >> np.uint64(32)
    x *= _MIX[0] + np.uint64(2 * width)
    x ^= x >> np.uint64(29)
    return np.unique(x)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def ordered(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Rare tokens by hash, then frequent ones by hash."""
    common = _within(tokens, frequent)
    return np.concatenate((tokens[~common], tokens[common]))


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """A bit for each token, in 64-bit words: 4 to 8 bits a token, a power of two in all."""
    width = 1 << max(0, int(4 * len(tokens) - 1).bit_length() - 6)
    words = np.zeros(min(width, 1024), np.uint64)
    at = (tokens >> np.uint64(20)) % np.uint64(64 * len(words))
    np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return words


def folded(words: np.ndarray, width: int) -> np.ndarray:
    return np.bitwise_or.reduce(words.reshape(-1, width), axis=0)


def _sets(source):
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.binary())])
    for batch in source:
        for piece in slices(batch):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([shingles(t).tobytes() for t in piece.column(1).to_pylist()], pa.binary())], schema=schema)


def _signs(source):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])
    for batch in source:
        for piece in slices(batch):
            sets = [shingles(t) for t in piece.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([bitmap(x).tobytes() if len(x) else b"" for x in sets], pa.binary())], schema=schema)


def _described(frequent: np.ndarray, percent: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_hash", pa.binary()), ("prefix", pa.binary())])

    def run(source):
        forget()
        for batch in source:
            for piece in slices(batch):
                rows = []
                for text in piece.column(1).to_pylist():
                    s = shingles(text)
                    head = ordered(s, frequent)[: prefix_length(len(s), percent)] if len(s) else s
                    rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), head.tobytes()))
                columns = list(zip(*rows, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(c, t.type) for c, t in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return run


def _sampled_tokens(source):
    for batch in source:
        for piece in slices(batch):
            tokens = np.concatenate([shingles(t) for t in piece.column(0).to_pylist()] + [np.empty(0, np.uint64)])
            tokens = tokens[tokens < SAMPLE_BELOW]
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64))], names=["token"])


def frequent_tokens(docs: DataFrame, sample: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of at least FREQUENT_AT documents of a sample, MOST_FREQUENT at most, ascending; and those of them that are hot."""
    total = docs.select("doc_id").count()
    if not total:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    share = min(1.0, sample / total)
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("shingles")), F.lit(1 << 30)) < int((1 << 30) * share)
    counts = docs.where(draw).select("text").mapInArrow(_sampled_tokens, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT_AT)
    found = counts.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).collect()
    tokens, hot = ([r["token"] for r in found if r["n"] > least * share] for least in (0, HOT_POSTERS))
    return tuple(np.sort(np.array(x, np.int64).view(np.uint64)) for x in (tokens, hot))


def _within(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values are in `some`, an ascending array."""
    if not len(some):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def _postings(buckets: int, hot: np.ndarray):
    """(bucket, tokens, doc_ids, sizes): the tokens of a few thousand documents, by bucket; hot tokens by document, in buckets of their own."""
    schema = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary()), ("docs", pa.binary())])

    def run(source):
        for batch in source:
            for piece in slices(batch, 2048):
                heads = [np.frombuffer(x, np.uint64) for x in piece.column(2).to_pylist()]
                tokens = np.concatenate([*heads, np.empty(0, np.uint64)])
                if not len(tokens):
                    continue
                own = np.stack([piece.column(0).to_numpy(), piece.column(1).to_numpy()], axis=1)[np.repeat(np.arange(len(heads)), [len(h) for h in heads])]
                bucket = np.where(_within(tokens, hot), buckets + own[:, 0] % buckets, (tokens % np.uint64(buckets)).astype(np.int64)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                first = np.flatnonzero(np.concatenate(([True], bucket[order][1:] != bucket[order][:-1])))
                cuts = np.append(first, len(tokens)).tolist()
                tokens, own = tokens[order], own[order].astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket[order][first]), pa.array([tokens[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                    pa.array([own[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                ], schema=schema)

    return run


def _block_rows(tokens: list[bytes], docs: list[bytes], percent: int) -> pa.RecordBatch:
    """The members of one bucket's blocks: posters of one token without a gap between their sizes that no link spans.

    Blocks with the same members are one, named by their hash.
    """
    token = np.frombuffer(b"".join(tokens), np.uint64)
    own = np.frombuffer(b"".join(docs), np.int64).reshape(-1, 2)
    order = np.lexsort((own[:, 0], own[:, 1], token))
    token, own = token[order], own[order]
    apart = (token[1:] != token[:-1]) | (100 * own[:-1, 1] < percent * own[1:, 1])
    first = np.flatnonzero(np.concatenate(([True], apart)))
    size = np.diff(np.append(first, len(token)))
    found = {}
    for a, z in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        members = own[a : a + z]
        found[xxhash.xxh3_64_intdigest(members.tobytes()) - (1 << 63)] = members
    rows = np.concatenate([*found.values(), np.empty((0, 2), np.int64)])
    names = np.repeat(np.array(list(found), np.int64), [len(m) for m in found.values()])
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["block", "doc_id", "n"])


def _hot_rows(tokens: bytes, docs: bytes) -> pa.RecordBatch:
    """Members of hot tokens' blocks, which are named by the tokens."""
    own = np.frombuffer(docs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(tokens, np.int64)), pa.array(own[:, 0]), pa.array(own[:, 1])], names=["block", "doc_id", "n"])


def _blocks(percent: int, buckets: int):
    """Rows come sorted by bucket; those from `buckets` on are of hot tokens and aren't put together."""

    def run(source):
        last, tokens, docs = None, [], []
        for batch in source:
            for bucket, t, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket >= buckets:
                    yield _hot_rows(t, d)
                    continue
                if bucket != last and tokens:
                    yield _block_rows(tokens, docs, percent)
                    tokens, docs = [], []
                last = bucket
                tokens.append(t)
                docs.append(d)
        if tokens:
            yield _block_rows(tokens, docs, percent)
        tokens, docs = [], []
        give_back()

    return run


def star_pairs(member: DataFrame, order, percent: int) -> DataFrame:
    """(a, b): each member of a block and the block's first in `order`, if not connected and near enough in size."""
    lead = member.groupBy("block").agg(F.max_by(F.struct("doc_id", "n", "label"), order).alias("lead"))
    sizes = 100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n")
    pairs = member.join(lead, "block").where(sizes & (F.col("label") != F.col("lead.label")))
    return pairs.select(F.least("doc_id", "lead.doc_id").alias("a"), F.greatest("doc_id", "lead.doc_id").alias("b")).distinct()


class Node:
    """A node of a signature tree over members sorted by size.

    A leaf keeps its members' sizes, ids, labels and bitmaps; `slack` bounds the tokens of a
    member that share a bit with another of its tokens.
    """

    __slots__ = ("bits", "high", "ids", "inner", "label", "labels", "low", "maps", "sizes", "slack")

    def __init__(self, members: list[tuple] | None, inner: list[Node] | None):
        """members: (size, doc_id, label, bitmap) of a leaf."""
        self.inner = inner
        if members is not None:
            self.sizes, self.ids, self.labels = (np.array([m[k] for m in members], np.int64) for k in range(3))
            width = min(len(m[3]) for m in members)
            self.maps = np.stack([folded(m[3], width) for m in members])
            self.low, self.high = members[0][0], members[-1][0]
            self.slack = int((self.sizes - np.bitwise_count(self.maps).sum(axis=1)).max())
            self.bits = np.bitwise_or.reduce(self.maps, axis=0)
            self.label = members[0][2] if (self.labels == members[0][2]).all() else None
        else:
            width = min(len(n.bits) for n in inner)
            self.low, self.high = inner[0].low, inner[-1].high
            self.slack = max(n.slack if len(n.bits) == width else n.high for n in inner)
            self.bits = np.bitwise_or.reduce([folded(n.bits, width) for n in inner], axis=0)
            self.label = inner[0].label if all(n.label == inner[0].label for n in inner) else None


def tree(members: list[tuple], fanout: int = 8) -> Node:
    level = [Node(members[k : k + LEAF], None) for k in range(0, len(members), LEAF)]
    while len(level) > 1:
        level = [Node(None, level[k : k + fanout]) for k in range(0, len(level), fanout)]
    return level[0]


def _apart(x: Node, y: Node, percent: int) -> bool:
    """True if no member of x can link to a member of y that it isn't connected to."""
    if x.label is not None and x.label == y.label:
        return True
    if 100 * x.high < percent * y.low or 100 * y.high < percent * x.low:
        return True
    width = min(len(x.bits), len(y.bits))
    shared = int(np.bitwise_count(folded(x.bits, width) & folded(y.bits, width)).sum())
    slack_x, slack_y = (n.slack if len(n.bits) == width else n.high for n in (x, y))
    return (100 + percent) * (shared + min(slack_x, slack_y)) < percent * (x.low + y.low)


def most_shared(p: np.ndarray, q: np.ndarray, n, m):
    """The largest overlap that bitmaps of one width allow: a bit of one that the other lacks is a token it lacks."""
    return np.minimum(n - np.bitwise_count(p & ~q).sum(axis=-1), m - np.bitwise_count(q & ~p).sum(axis=-1))


def _leaf_pairs(x: Node, y: Node, percent: int) -> np.ndarray:
    width = min(len(x.bits), len(y.bits))
    p, q = (np.bitwise_or.reduce(z.maps.reshape(len(z.ids), -1, width), axis=1) for z in (x, y))
    n, m = x.sizes[:, None], y.sizes[None, :]
    ok = (100 + percent) * most_shared(p[:, None], q[None], n, m) >= percent * (n + m)
    ok &= (x.labels[:, None] != y.labels[None]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (x.ids[:, None] != y.ids[None])
    if x is y:
        ok = np.triu(ok, 1)
    a, b = np.nonzero(ok)
    return np.stack([x.ids[a], y.ids[b]], axis=1)


def traverse(x: Node, y: Node, percent: int = PERCENT):
    """Arrays of pairs of doc_ids that may link, from two trees traversed together (or one with itself)."""
    stack = [(x, y)]
    while stack:
        x, y = stack.pop()
        if _apart(x, y, percent):
            continue
        if x.inner is None and y.inner is None:
            yield _leaf_pairs(x, y, percent)
        elif x is y:
            stack += [(p, q) for k, p in enumerate(x.inner) for q in x.inner[k:]]
        elif y.inner is None or (x.inner is not None and x.high >= y.high):
            stack += [(p, y) for p in x.inner]
        else:
            stack += [(x, q) for q in y.inner]


def _tree_pairs(percent: int):
    """A task's members are on side 0, 1 or, for a part with itself, 0 alone."""

    def run(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_pylist() for c in ("n", "doc_id", "label", "bits", "side")]
        rows = sorted(zip(*columns, strict=True), key=lambda m: m[:2])
        sides = [[(*m[:3], np.frombuffer(m[3], np.uint64)) for m in rows if m[4] == side] for side in (0, 1)]
        trees = [tree(m) for m in sides if m]
        pairs = np.concatenate([*traverse(trees[0], trees[-1], percent), np.empty((0, 2), np.int64)])
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _tasks(member: DataFrame, part: int) -> DataFrame:
    """task, side, doc_id: what trees are to be traversed with what (member: block, doc_id, n, label)."""
    counts = member.groupBy("block", "label").agg(F.count("*").alias("own"))
    sizes = counts.groupBy("block").agg(F.sum("own").alias("size"), F.count("*").alias("labels")).where("labels > 1")
    hubs = counts.join(sizes, "block").where((F.col("own") >= HUB) & (F.col("own") * 10 >= F.col("size"))).select("block", F.col("label").alias("hub"))
    mixed = member.join(sizes.select("block"), "block", "left_semi")

    # Hubs: the whole component on one side, in parts, and its guests on the other.
    guests = mixed.join(hubs, "block").where("label <> hub").select("hub", "doc_id").distinct()
    guests = guests.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)))
    many = guests.groupBy("hub").agg(F.ceil(F.count("*") / part).cast("int").alias("guest_parts"))
    inside = member.select(F.col("label").alias("hub"), "doc_id").distinct().join(many.select("hub"), "hub", "left_semi")
    plenty = inside.groupBy("hub").agg(F.ceil(F.count("*") / part).cast("int").alias("hub_parts")).join(many, "hub")
    own = inside.join(plenty, "hub").select("hub", "doc_id", F.pmod(F.xxhash64("doc_id"), F.col("hub_parts")).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.col("guest_parts") - 1)).alias("q"), F.lit(0).alias("side"))
    visit = guests.join(plenty, "hub").select("hub", "doc_id", F.explode(F.sequence(F.lit(0), F.col("hub_parts") - 1)).alias("p"), F.pmod(F.col("part"), F.col("guest_parts")).cast("int").alias("q"), F.lit(1).alias("side"))
    of_hubs = own.unionByName(visit).select(F.struct("hub", "p", "q").alias("task"), "side", "doc_id")

    # The rest of each block, in parts by hash; equal rests are traversed once.
    rest = mixed.join(hubs, (mixed["block"] == hubs["block"]) & (mixed["label"] == hubs["hub"]), "left_anti")
    about = rest.groupBy("block").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("name"), F.sum(F.xxhash64("doc_id", F.lit(1)).cast("decimal(38,0)")).alias("name_2")).where("low <> high")
    about = about.groupBy("name", "name_2", "size").agg(F.min("block").alias("block")).select("block", F.ceil(F.col("size") / part).cast("int").alias("parts"))
    rest = rest.join(about, "block").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    pairs = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    sided = rest.select("block", "doc_id", "part", pairs.alias("other")).select("block", "doc_id", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), (F.col("part") > F.col("other")).cast("int").alias("side"))
    return of_hubs.unionByName(sided.select(F.struct(F.col("block").alias("hub"), F.col("p"), F.col("q")).alias("task"), "side", "doc_id"))


def _linked(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(source):
        for batch in source:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append((100 + percent) * both >= percent * (len(p) + len(q)) and both > 0)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], schema=schema)

    return run


def _of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is in ids, which are broadcast while they are few."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def verified(docs: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    texts = _of(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct())
    sets = settle(texts.mapInArrow(_sets, "doc_id long, tokens binary").distinct())
    left, right = (sets.select(F.col("doc_id").alias(c), F.col("tokens").alias(f"tokens_{c}")) for c in "ab")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "tokens_a", "tokens_b")
    return joined.mapInArrow(_linked(percent), "a long, b long").distinct()


def _may_link(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(source):
        for batch in source:
            keep = []
            for n, m, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                width = min(len(p), len(q))
                most = int(most_shared(folded(p, width), folded(q, width), n, m))
                keep.append((100 + percent) * most >= percent * (n + m))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], schema=schema)

    return run


def join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    docs = small_batches(docs).select("doc_id", "text")
    frequent, hot = frequent_tokens(docs)
    rows = settle(docs.mapInArrow(_described(frequent, percent), "doc_id long, n long, set_hash binary, prefix binary"))
    classes = settle(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("set_hash").agg(F.min("doc_id").alias("rep")))
    reps = _of(rows.where("n > 0"), classes.select(F.col("rep").alias("doc_id")).distinct())

    buckets = BUCKETS_EACH * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = reps.select("doc_id", "n", "prefix").mapInArrow(_postings(buckets, hot), "bucket int, tokens binary, docs binary")
    posted = settle(postings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_blocks(percent, buckets), "block long, doc_id long, n long"))
    degree = posted.groupBy("doc_id").agg(F.count("*").alias("degree"))
    blocks = settle(posted.dropDuplicates(["block", "doc_id"]).join(degree, "doc_id"))
    signs = settle(_of(docs, degree.select("doc_id")).mapInArrow(_signs, "doc_id long, n long, bits binary").dropDuplicates(["doc_id"]))
    left, right = (signs.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")

    def labelled(df: DataFrame) -> DataFrame:
        return df.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))

    stars = star_pairs(blocks.withColumn("label", F.col("doc_id")), F.struct("degree", -F.col("doc_id")), percent)
    tried = settle(stars.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_may_link(percent), "a long, b long"))
    links = settle(verified(docs, tried, percent))
    labels = components(links)

    tasks = _tasks(labelled(blocks), PART).join(labelled(signs), "doc_id")
    found = tasks.groupBy("task").applyInArrow(_tree_pairs(percent), "a long, b long").distinct()
    links = links.unionAll(verified(docs, settle(found.join(tried, ["a", "b"], "left_anti")), percent))

    final = components(settle(links))
    of_class = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("set_hash", F.coalesce("label", "rep").alias("component_id"))
    full = rows.where("n > 0").join(of_class, "set_hash", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return full.unionAll(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def links(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(rep, near) and (doc_id, rep): all pairs of different sets that link, in both directions, and the sets of each document.

    A set is named by a number of its own. Nothing is dropped for being connected, so the work
    grows with the number of links; copies of one set are one.
    """
    numbered = settle(small_batches(docs).where("doc_id IS NOT NULL").select("doc_id", "text", F.monotonically_increasing_id().alias("row")))
    single = numbered.select(F.col("row").alias("doc_id"), "text")  # each row is a document with one set
    frequent, hot = frequent_tokens(single)
    rows = settle(single.mapInArrow(_described(frequent, percent), "doc_id long, n long, set_hash binary, prefix binary").where("n > 0"))
    classes = settle(rows.groupBy("set_hash").agg(F.min("doc_id").alias("rep")))
    of_row = rows.join(classes, "set_hash").select(F.col("doc_id").alias("row"), "rep")
    sets = settle(numbered.select("doc_id", "row").join(of_row, "row").select("doc_id", "rep").distinct())

    buckets = BUCKETS_EACH * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reps = _of(rows, classes.select(F.col("rep").alias("doc_id")))
    postings = reps.select("doc_id", "n", "prefix").mapInArrow(_postings(buckets, hot), "bucket int, tokens binary, docs binary")
    posted = postings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_blocks(percent, buckets), "block long, doc_id long, n long")
    blocks = settle(posted.dropDuplicates(["block", "doc_id"]).withColumn("label", F.col("doc_id")))
    signs = settle(_of(single, blocks.select("doc_id").distinct()).mapInArrow(_signs, "doc_id long, n long, bits binary"))
    tasks = _tasks(blocks, PART).join(signs.withColumn("label", F.col("doc_id")), "doc_id")
    found = settle(tasks.groupBy("task").applyInArrow(_tree_pairs(percent), "a long, b long").distinct())
    linked = settle(verified(single, found, percent))
    return linked.selectExpr("a AS rep", "b AS near").unionAll(linked.selectExpr("b AS rep", "a AS near")), sets


def link_counts(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_links: to how many other documents each document links, connected or not.

    Documents with one set are counted by their set; only those with several are listed.
    """
    linked, sets = links(docs, percent)
    reach = settle(linked.unionAll(sets.selectExpr("rep", "rep AS near").distinct()))
    several = settle(sets.groupBy("doc_id").agg(F.count("*").alias("sets")).where("sets > 1").select("doc_id"))
    alone, many = sets.join(several, "doc_id", "left_anti"), sets.join(several, "doc_id", "left_semi")

    def counted(starts: DataFrame) -> DataFrame:
        near = settle(starts.join(reach, "rep").select("owner", "near").distinct())
        ones = near.join(alone.groupBy(F.col("rep").alias("near")).agg(F.count("*").alias("n")), "near").groupBy("owner").agg(F.sum("n").alias("ones"))
        others = near.join(many.select(F.col("rep").alias("near"), "doc_id"), "near").groupBy("owner").agg(F.count_distinct("doc_id").alias("others"))
        return ones.join(others, "owner", "full").select("owner", (F.coalesce("ones", F.lit(0)) + F.coalesce("others", F.lit(0)) - 1).alias("n_links"))

    by_set = alone.join(counted(alone.selectExpr("rep AS owner", "rep").distinct()).withColumnRenamed("owner", "rep"), "rep").select("doc_id", "n_links")
    by_id = counted(many.selectExpr("doc_id AS owner", "rep")).withColumnRenamed("owner", "doc_id")
    ids = docs.where("doc_id IS NOT NULL").select("doc_id").distinct()
    return ids.join(by_set.unionAll(by_id), "doc_id", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without all but the smallest id of each component, and one row for each id.

    Rows without an id stay. Only ids that go, or that come more than once, are joined.
    """
    columns = docs.columns
    gone = settle(join(docs, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("id")).distinct())
    twice = settle(docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id"))
    gone, twice = (F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids for ids in (gone, twice))
    kept = docs.select(F.col("doc_id").alias("id"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")).join(gone, "id", "left_anti")
    once = kept.join(twice, "id", "left_anti").unionByName(kept.join(twice, "id", "left_semi").dropDuplicates(["id"]))
    return once.select(*[F.col("row").getField(c).alias(c) for c in columns])
