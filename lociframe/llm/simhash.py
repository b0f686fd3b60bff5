"""SimHash near-duplicate groups by bit-sliced comparison.

Fingerprints come from word shingles, hashed with XXH64; two documents link where their fingerprints differ
in at most ``radius`` bits, and a group is what links connect.

Search: equal fingerprints are joined first, so each distinct one is compared once. Of ``radius + 1`` bit
bands, two linked fingerprints agree in one at least, so rows meet by (band, value). A bucket of over
``hot`` fingerprints is split again by bands of the bits that none of its bands had, where the same holds; that is
repeated, and loses no link. What is still hot after ``depth`` levels is dealt into blocks, and each pair of blocks is a
bucket. A task then reads its buckets in order and compares blocks: the block's bit
planes lie vertically, 64 fingerprints to a machine word, distances of all queries grow in carry-save bitwise
counters, and queries or words whose lanes all exceed the radius are abandoned. Of a block's links, a
spanning forest goes on, so a dense group gives one link per member instead of all pairs.

Groups: alternating large-star and small-star steps on the links, each written to the shared checkpoint
folder; the driver only sees two totals per round.

Defined results: null and empty texts have fingerprint 0 and link like others; long texts are hashed whole; rows are
fingerprinted one by one, so repeated rows share a group; rows with a null id take part, and a group of such rows only has a null
component; an empty table gives an empty table; only the id column and the results are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociframe.llm.shared import materialize, named, shared_dir

SEED = 42
BLOCK = 4096
ALL = np.uint64(0xFFFF_FFFF_FFFF_FFFF)


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    words = (text or b"").lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, SEED) for s in shingles), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of ``hashes``."""
    n = len(hashes)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``id, fp`` with the 64 bits as a signed number."""
    source = docs.select(named(id).alias("id"), named(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    return source.mapInArrow(run, T.StructType([source.schema["id"], T.StructField("fp", T.LongType())]))


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Row p holds bit p of all fingerprints, 64 to a word; lanes beyond the last are zero."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), 8), axis=1, bitorder="little").T
    packed = np.packbits(np.pad(bits, ((0, 0), (0, -len(fps) % 64))), axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64)


def near_pairs(queries: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices ``(query, fingerprint)`` of all pairs within ``radius`` bits (below 8)."""
    planes = bit_planes(fps)
    words = planes.shape[1]
    # One row for each query and word of 64 lanes; full, or abandoned, rows leave.
    query, word = (x.ravel() for x in np.meshgrid(np.arange(len(queries)), np.arange(words), indexing="ij"))
    ones, twos, fours, over = (np.zeros(len(query), np.uint64) for _ in range(4))
    if len(fps) % 64:
        over[word == words - 1] = ALL << np.uint64(len(fps) % 64)
    for p in range(64):
        flip = np.uint64(0) - (queries[query] >> np.uint64(p) & np.uint64(1))
        carry = planes[p][word] ^ flip
        carry, ones = ones & carry, ones ^ carry
        carry, twos = twos & carry, twos ^ carry
        carry, fours = fours & carry, fours ^ carry
        over |= carry
        over |= _above(ones, twos, fours, radius)
        if p % 4 == 3:
            live = over != ALL
            if not live.all():
                query, word, ones, twos, fours, over = (x[live] for x in (query, word, ones, twos, fours, over))
    lanes = np.unpackbits((~over).view(np.uint8).reshape(len(over), 8), axis=1, bitorder="little")
    row, lane = np.nonzero(lanes)
    return query[row], word[row] * 64 + lane


def _above(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit count is over ``radius``."""
    out, equal = np.zeros_like(ones), np.full_like(ones, ALL)
    for bit, counter in ((4, fours), (2, twos), (1, ones)):
        if radius & bit:
            equal &= counter
        else:
            out |= equal & counter
            equal &= ~counter
    return out


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` reaches over the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def block_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within ``radius`` among distinct fingerprints; more than a block is compared block by block."""
    from_, to = [], []
    for i in range(0, len(fps), BLOCK):
        for j in range(i, len(fps), BLOCK):
            q, f = near_pairs(fps[i : i + BLOCK], fps[j : j + BLOCK], radius)
            part = np.concatenate([fps[i : i + BLOCK], fps[j : j + BLOCK]])
            root = forest(len(part), q, f + len(fps[i : i + BLOCK]))
            moved = np.flatnonzero(part[root] != part)
            from_.append(part[moved])
            to.append(part[root[moved]])
    return (np.concatenate(from_), np.concatenate(to)) if from_ else (fps[:0], fps[:0])


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(fps: np.ndarray) -> pa.RecordBatch:
            a, b = block_links(np.unique(fps), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])

        # Whole buckets fill a block; a bucket goes on over batches until the next one begins.
        held_fp, held_key = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            held_fp = np.concatenate([held_fp, b.column("fp").to_numpy().view(np.uint64)])
            held_key = np.concatenate([held_key, b.column("bucket").to_numpy()])
            starts = np.flatnonzero(np.concatenate([[True], held_key[1:] != held_key[:-1]])) if len(held_key) else []
            begin = 0
            for s in starts:
                if s - begin >= BLOCK // 2:
                    yield links(held_fp[begin:s])
                    begin = s
            held_fp, held_key = held_fp[begin:], held_key[begin:]
        if len(held_fp):
            yield links(held_fp)

    return run


def _bands(bits: list[int], n: int) -> list[list[int]]:
    """``bits`` in ``n`` even runs."""
    return [bits[len(bits) * i // n : len(bits) * (i + 1) // n] for i in range(n)]


def near_links(distinct: DataFrame, radius: int = 3, hot: int = 8192, depth: int = 3) -> DataFrame:
    """Links ``u, v`` between distinct fingerprints (column ``fp``) that connect all pairs within ``radius``."""
    link = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])

    def value(bits: list[int]):
        return F.shiftrightunsigned(F.col("fp"), bits[0]).bitwiseAND(F.lit((1 << len(bits)) - 1))

    # A path is the bands chosen so far; the rows of one path and key are a bucket.
    bits = list(range(64))
    rests = [sorted(set(bits) - set(b)) for b in _bands(bits, radius + 1)]
    start = F.array(*[F.struct(F.lit(i).alias("path"), value(b).alias("key")) for i, b in enumerate(_bands(bits, radius + 1))])
    rows = distinct.select("fp", F.explode(start).alias("b")).select("fp", F.xxhash64("b.path", "b.key").alias("bucket"), F.col("b.path").alias("path"))
    compare = lambda df: df.repartition("bucket").sortWithinPartitions("bucket").select("fp", "bucket").mapInArrow(_compare(radius), link)
    found = None
    for level in range(depth):
        sizes = materialize(rows.groupBy("bucket").count().where(F.col("count") > hot), "simhash-hot")
        more = bool(sizes.limit(1).count())
        part = compare(rows.join(sizes.select("bucket"), "bucket", "left_anti") if more else rows)
        found = part if found is None else found.unionByName(part)
        if not more:
            return found
        if level + 1 < depth:
            finer = [(i, sub, sorted(set(rest) - set(sub))) for i, rest in enumerate(rests) for sub in _bands(rest, radius + 1)]
            rests = [rest for _, _, rest in finer]
            pick = F.array(*[F.struct(F.lit(i).alias("from"), F.lit(k).alias("path"), _gather(sub).alias("key")) for k, (i, sub, _) in enumerate(finer)])
            rows = (
                rows.join(sizes.select("bucket"), "bucket", "left_semi")
                .select("fp", "bucket", F.explode(F.filter(pick, lambda x: x.getField("from") == F.col("path"))).alias("b"))
                .select("fp", F.xxhash64("bucket", "b.path", "b.key").alias("bucket"), F.col("b.path").alias("path"))
            )
    # Blocks of about half of ``hot``; each goes to its pairs with all blocks of the bucket.
    dealt = rows.join(sizes, "bucket").withColumn("n", F.ceil(2 * F.col("count") / hot)).withColumn("i", F.pmod(F.xxhash64("fp"), "n"))
    pairs = dealt.select("fp", "bucket", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    return found.unionByName(compare(pairs.select("fp", F.xxhash64("bucket", F.least("i", "j"), F.greatest("i", "j")).alias("bucket"))))


def _gather(bits: list[int]):
    """The chosen bits of ``fp``, others zero."""
    mask = sum(1 << b for b in bits)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each linked node reaches, by alternating star steps until nothing changes."""
    shared_dir(links.sparkSession)

    def star(edges: DataFrame, large: bool) -> DataFrame:
        # Large: every neighbour above a node goes to the least around it. Small: those below it do, and itself.
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = around.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k"))
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where(F.col("u") != F.col("v")).distinct()

    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct().checkpoint()
    total = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = total(edges)
    while seen[0]:
        edges = star(star(edges, large=True), large=False).checkpoint()
        now = total(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def simhash_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3, hot: int = 8192) -> DataFrame:
    """``id, fp, component_id``: the smallest id of the document's group."""
    fps = materialize(fingerprints(docs, id, text, shingle), "simhash-fp")
    classes = materialize(fps.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    roots = components(near_links(classes.select("fp"), radius, hot))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(groups, "root").select(F.col("fp").alias("_fp"), "component_id")
    return fps.join(by_fp, F.col("fp") == F.col("_fp"), "left").select(F.col("id").alias(id), "fp", "component_id")
