"""SimHash fingerprints with DataFrame functions only.

Each word of a text votes with its 64-bit hash: its weight (its length, at most MAX_WEIGHT)
for every bit that is set, against every other. The signs of the sums are the fingerprint.
Votes are summed by document before anything is shuffled, three bits in one long, in chunks
of a text small enough for the lanes.

within_radius() finds all fingerprints in a Hamming radius by permuted block tables: the 64
bits are cut into blocks, and two fingerprints that differ in at most `radius` bits agree on
some choice of `blocks - radius` blocks, so one table for each choice finds them all. Blocks
that many fingerprints share are cut the same way once more, in the bits that are left.
compare() searches all distinct fingerprints of its rows and counts what each has near it.

following() pairs each document with the next in descending order of id without one task that
sees all rows: ids are dealt to ranges by quantiles and, within these, to equal steps; the
head of each bucket is copied to the end of the bucket before it, and of the first to the
last. Repeated ids follow each other by text, descending; null ids come last.

Defined cases: a null text is empty; an empty text's fingerprint is all zeros. Equal texts
have equal fingerprints. One document is its own next. An empty table gives an empty table.
Other columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import WORD_GAP, settle

BITS = 64
MAX_WEIGHT = 8
#: Words of a chunk: MAX_WEIGHT times as many fit a lane of 21 bits.
CHUNK_WORDS = 1 << 17
RANGES = 64
BUCKET_ROWS = 1000
#: Heads of buckets that may be broadcast: 24 bytes each.
BROADCAST_HEADS = 200_000
RADIUS = 3
BLOCKS = 6
#: Fingerprints that may share a block before it is cut once more.
BLOCK_ROWS = 200
#: Parts into which the rows of one fingerprint are dealt to meet its counts.
SALTS = 32


def _balanced(terms: list, join):
    """The terms joined as a shallow tree, which generated code can hold."""
    while len(terms) > 1:
        terms = [join(*terms[k : k + 2]) if k + 1 < len(terms) else terms[k] for k in range(0, len(terms), 2)]
    return terms[0]


def _looked_up(values: dict, none) -> Column:
    """The value of each range, which are numbered from -1 on."""
    return F.element_at(F.array(*[F.lit(values.get(no, none)) for no in range(-1, RANGES)]), F.col("range") + 2)


def following(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """bucket, place, halo, doc_id, text, next_text. Rows with halo are copies of another bucket's head."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = rows.where(F.col("doc_id").isNotNull())
    n, quantiles = known.agg(F.count("*"), F.percentile_approx("doc_id", [k / RANGES for k in range(1, RANGES)], 1000)).first()
    steps = max(1, -(-n // (RANGES * bucket_rows)))
    bounds = sorted(set(quantiles or []))
    range_no = _balanced([(F.col("doc_id") >= b).cast("int") for b in bounds] or [F.lit(0)], lambda a, b: a + b)
    ranged = rows.withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(range_no))
    ends = {r["range"]: (r["low"], r["high"]) for r in ranged.groupBy("range").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect()}  # RANGES + 1 rows at most
    low, wide = (_looked_up({no: float(v[0] or 0) if k == 0 else float(max(1, (v[1] or 0) - (v[0] or 0))) for no, v in ends.items()}, 0.0) for k in (0, 1))
    step = F.coalesce(F.least(F.floor((F.col("doc_id").cast("double") - low) / wide * steps), F.lit(steps - 1)), F.lit(0))
    dealt = ranged.withColumn("bucket", F.col("range").cast("long") * steps + step.cast("long"))
    heads = dealt.groupBy("range", "bucket").agg(F.max("doc_id").alias("head"))
    # The head of a bucket follows the last row of the next bucket up; at a range's upper end, of the lowest bucket of the next range.
    lowest = {r["range"]: r["low"] for r in heads.groupBy("range").agg(F.min("bucket").alias("low")).collect()}
    order = sorted(lowest)
    above = {no: lowest[order[(k + 1) % len(order)]] for k, no in enumerate(order)}
    goes_to = F.coalesce(F.lead("bucket").over(Window.partitionBy("range").orderBy("bucket")), _looked_up(above, 0))
    heads = settle(heads.select("bucket", "head", goes_to.alias("goes_to")))
    few = heads.count() <= BROADCAST_HEADS
    copies = dealt.select("bucket", "doc_id", "text").join(F.broadcast(heads) if few else heads, "bucket").where(F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("goes_to", "doc_id").agg(F.max("text").alias("text"))
    both = dealt.select("bucket", F.lit(0).alias("halo"), "doc_id", "text").unionByName(copies.select(F.col("goes_to").alias("bucket"), F.lit(1).alias("halo"), "doc_id", "text"))
    along = Window.partitionBy("bucket").orderBy("halo", F.desc("doc_id"), F.desc("text"))
    return both.select("bucket", F.row_number().over(along).alias("place"), "halo", "doc_id", "text", F.lead("text").over(along).alias("next_text"))


def _lanes(h: str, first: int) -> str:
    """Bits first, first + 1 and first + 2 of h as lanes of 21 bits."""
    x = f"shiftrightunsigned({h}, {first})" if first else h
    lanes = [f"({x} & 1L)", f"shiftleft({x} & 2L, 20)", f"shiftleft({x} & 4L, 40)"][: BITS - first]
    return "(" + " | ".join(lanes) + ")"


def fingerprints(texts: DataFrame, key: str = "key", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """key (a long), fingerprint (a long) and the numbers in `carry` of each text; keys must be unique."""
    words = texts.select(F.col(key).alias("key"), *carry, F.posexplode(F.split(F.col(text), WORD_GAP)).alias("pos", "word"))
    votes = words.selectExpr("key", *carry, f"pos div {CHUNK_WORDS} AS chunk", "xxhash64(word) AS h", f"cast(least(char_length(word), {MAX_WEIGHT}) AS bigint) AS w")
    own = [F.max(c).alias(c) for c in carry]
    packed = votes.groupBy("key", "chunk").agg(*own, F.sum("w").alias("total"), *[F.expr(f"sum(w * {_lanes('h', a)})").alias(f"v{a}") for a in range(0, BITS, 3)])
    lanes = packed.select("key", *carry, "total", *[F.expr(f"shiftrightunsigned(v{b - b % 3}, {21 * (b % 3)}) & 2097151L").alias(f"b{b}") for b in range(BITS)])
    sums = lanes.groupBy("key").agg(*own, F.sum("total").alias("total"), *[F.sum(f"b{b}").alias(f"b{b}") for b in range(BITS)])
    signed = _balanced([f"if(2 * b{b} > total, shiftleft(1L, {b}), 0L)" for b in range(BITS)], lambda a, b: f"({a} | {b})")
    return sums.select("key", *carry, F.expr(signed).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / BITS


def hexed(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), BITS // 4, "0"))


def edited(text: Column, next_text: Column) -> Column:
    """text with its last half replaced by as much of the next text's beginning."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.left(text, F.char_length(text) - half), F.left(next_text, half))


def _as_long(digits: Column) -> Column:
    """16 hex digits as a signed long; hexed() gives them back."""
    x = F.conv(digits, 16, 10).cast("decimal(20,0)")
    half = F.lit(Decimal(1 << 63))
    return F.when(x >= half, x - half - half).otherwise(x).cast("long")


def compare(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, radius: int = RADIUS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_fingerprints, near_documents.

    The last two count the other distinct fingerprints, and the other rows, in `radius` bits of
    a row's fingerprint. Texts are shuffled once, to meet their next; what else the result needs
    of a document goes along with its votes as numbers, the SHA-256 as four.
    """
    key = (F.col("bucket") + 1) * (1 << 32) + F.col("place") * 2
    rows = following(docs, bucket_rows).select("halo", "doc_id", "text", F.when(F.col("halo") == 0, edited(F.col("text"), F.col("next_text"))).alias("edited"), key.alias("key"))
    sha = [f"sha{k}" for k in range(4)]
    rows = rows.withColumn("sha", F.sha2("edited", 256)).withColumns({c: _as_long(F.substring("sha", 16 * k + 1, 16)) for k, c in enumerate(sha)} | {"n_chars": F.char_length("text").cast("long")}).drop("sha")
    info = ("halo", "doc_id", "n_chars", *sha)
    texts = F.inline(F.array(F.struct(F.col("key").alias("own"), F.col("text").alias("body")), F.struct((F.col("key") + 1).alias("own"), F.col("edited").alias("body"))))
    both = rows.select(*info, texts).where(F.col("body").isNotNull())
    prints = fingerprints(both, "own", "body", info)
    odd = F.pmod(F.col("key"), F.lit(2))
    pairs = prints.groupBy((F.col("key") - odd).alias("key")).agg(*[F.max(c).alias(c) for c in info], F.max(F.when(odd == 0, F.col("fingerprint"))).alias("a"), F.max(F.when(odd == 1, F.col("fingerprint"))).alias("b"))
    ahead = F.lead("a").over(Window.partitionBy(F.shiftright("key", 32)).orderBy("key"))
    done = settle(pairs.withColumn("next", ahead).where("halo = 0").select("key", "doc_id", "n_chars", *sha, "a", "b", "next"))
    # Rows of a frequent fingerprint are dealt to parts by their keys, which are unique; its counts go to each part.
    near = neighbours(done.select(F.col("a").alias("fingerprint")), radius).select(F.col("fingerprint").alias("a"), "near_fingerprints", "near_documents", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    met = done.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(near, ["a", "part"], "left")
    return met.select(
        "doc_id", "n_chars", F.concat(*[hexed(F.col(c)) for c in sha]).alias("edited_sha256"), hexed(F.col("a")).alias("fingerprint"), hexed(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("next")).alias("near_next"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("near_fingerprints", "near_documents")],
    )


def neighbours(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fingerprint, near_fingerprints, near_documents: other distinct fingerprints and other rows in the radius; without fingerprints that have none."""
    counted = settle(rows.groupBy("fingerprint").agg(F.count("*").alias("n")))
    found = within_radius(counted, counted, radius).join(counted, "fingerprint")
    near = found.groupBy("query").agg((F.count("*") - 1).alias("near_fingerprints"), (F.sum("n") - 1).alias("near_documents"))
    return near.where("near_documents > 0").withColumnRenamed("query", "fingerprint")


def _masks(bits: list[int], radius: int, blocks: int) -> list[list[int]]:
    """For each choice of blocks that may agree, the bits in them; `bits` are cut into blocks of nearly the same size."""
    cut = [bits[len(bits) * k // blocks : len(bits) * (k + 1) // blocks] for k in range(blocks)]
    return [sum((cut[k] for k in kept), []) for kept in combinations(range(blocks), blocks - radius)]


def _mask(bits: list[int]) -> Column:
    m = sum(1 << b for b in bits)
    return F.lit(m - (1 << 64) if m >> 63 else m)


def block_keys(fingerprint: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """(table, key) for each choice of blocks that may agree: the fingerprint's bits in them."""
    return F.array(*[F.struct(F.lit(t).alias("table"), fingerprint.bitwiseAND(_mask(kept)).alias("block")) for t, kept in enumerate(_masks(list(range(BITS)), radius, blocks))])


def _finer_keys(fingerprint: Column, table: Column, radius: int, blocks: int) -> Column:
    """(finer, kept): the bits that a table leaves open, cut into blocks in turn; for each choice of these, the fingerprint's bits in them."""
    left = [[b for b in range(BITS) if b not in kept] for kept in _masks(list(range(BITS)), radius, blocks)]
    masks = F.element_at(F.array(*[F.array(*[_mask(kept) for kept in _masks(bits, radius, blocks)]) for bits in left]), table + 1)
    return F.transform(masks, lambda m, k: F.struct(k.alias("finer"), fingerprint.bitwiseAND(m).alias("kept")))


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query, fingerprint, distance: all distinct pairs of the two `fingerprint` columns (longs) that differ in at most `radius` bits.

    A block is shared by at most `block_rows` fingerprints, or is cut once more.
    """
    sides = queries.select("fingerprint", F.lit(1).alias("asks"), F.lit(0).alias("answers")).unionByName(prints.select("fingerprint", F.lit(0).alias("asks"), F.lit(1).alias("answers")))
    values = settle(sides.where(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.max("asks").alias("asks"), F.max("answers").alias("answers")))
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fingerprint")))

    def shared(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.withColumn("rows", F.count("*").over(Window.partitionBy(*keys))).where("rows > 1")

    def met(df: DataFrame, keys: list[str]) -> DataFrame:
        asking = df.where("asks = 1").select(*keys, F.col("fingerprint").alias("query"))
        found = asking.join(df.where("answers = 1").select(*keys, "fingerprint"), keys).where((F.col("query") != F.col("fingerprint")) & (distance <= radius))
        return found.select("query", "fingerprint")

    tabled = settle(shared(values.select("*", F.inline(block_keys(F.col("fingerprint"), radius, blocks))), ["table", "block"]))
    finer = tabled.where(F.col("rows") > block_rows).select("table", "block", "fingerprint", "asks", "answers", F.inline(_finer_keys(F.col("fingerprint"), F.col("table"), radius, blocks)))
    finer = settle(shared(finer, ["table", "block", "finer", "kept"]))
    found = met(tabled.where(F.col("rows") <= block_rows), ["table", "block"]).unionByName(met(finer, ["table", "block", "finer", "kept"])).distinct()
    same = values.where("asks = 1 AND answers = 1").select(F.col("fingerprint").alias("query"), "fingerprint")
    return found.unionByName(same).select("query", "fingerprint", distance.alias("distance"))
