"""Near-duplicate groups by the Jaccard similarity of word shingles, exact: the pipeline's near-duplicate stage.

Two rows link where the sets of their shingles (``shingle`` words, compared by XXH64) have a Jaccard similarity of
at least ``similarity``; a group is what links connect, and the row of the smallest id stays of each.

Search: the sets' SimHash fingerprints are compared by the bit-sliced search of ``simhash``, and rows whose fingerprints
differ in at most ``RADIUS`` bits are the first candidates. Similar sets can be further apart in bits (see the README), so
those that it can't find are met by their shingles. Candidates of both are confirmed on the whole sets.

Shingles: sets are ordered by one order for all, with shingles that a sample shows to be frequent at the end. Two sets
that are similar enough share a shingle among their first ``n - ceil(similarity * n) + 1``, so rows meet by these
shingles, and no pair is missed whatever the order is. Equal sets are one row before that.

A first pass takes from each bucket (the rows of a shingle, sorted by set size) only the pairs with the row before
and with the first row of a size close enough, and confirms them on the whole sets. The second takes all pairs of a
bucket that the first left in different groups, unless sizes, places, or parity sketches (the sets differ in as many
shingles at least as the sketches differ in bits) rule them out, and confirms these too. So a dense group gives a few
links for each member instead of all pairs. Rows that share a shingle and pass all bounds without being similar still
count by pairs. Buckets are compared by sketches of 512 bits; before sets are, pairs must pass by sketches of a bit or
two for each shingle, which tell long texts apart too, so that few sets of other texts travel.

Sets are not stored: one pass writes each row's digest, sketches and the shingles by which it meets others; the sets of
the rows that have candidates are computed again. Tables that are read for the last time are deleted.

Defined results: null, empty and blank texts are equal to each other; texts shorter than a shingle are one shingle; long
texts are taken whole; a null id comes last; of equal ids the first row stays, repeated rows being equal texts; an empty
table gives an empty table; all columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.llm.shared import materialize, named, release
from lociframe.llm.simhash import SEED, components, majority, near_links

RADIUS = 3  # bits between fingerprints of candidates
BITS = 512
SAMPLE, FREQUENT = 8, 200_000
BLOCK = 512
MARKS = "row long, n int, digest binary, sketch binary, wide binary, prefix binary, fp long"
SETS = "row long, hashes binary"
SHARED = "h long, row long, n int, at int, hub long, before long"
PAIR = "u long, v long"


def shingles(text: bytes | None, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or b"").lower().split()  # of bytes: ASCII letters and white space only
    parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in parts), np.uint64, max(1, len(words) - shingle + 1)))


def sketch(hashes: np.ndarray, bits: int = BITS) -> bytes:
    """Parity of the number of hashes at each of ``bits`` places."""
    return np.packbits((np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def wide(hashes: np.ndarray) -> bytes:
    """A sketch of as many places as there are hashes, or up to twice as many: ``BITS`` times a power of two."""
    return sketch(hashes, max(BITS, 1 << (len(hashes) - 1).bit_length()))


def differing(x: bytes, y: bytes) -> int:
    """Places where two sketches differ; the longer one is folded to the length of the other, which keeps parities."""
    size = min(len(x), len(y))
    a, b = (np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, size // 8), axis=0) for s in (x, y))
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``row, hashes`` of ``texts`` (``row, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([shingles(t, shingle).tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["row", "hashes"])

    return texts.mapInArrow(run, SETS)


def frequent(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``FREQUENT`` shingles that a sample holds most often, sorted, and their counts. Only the order of sets depends on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = np.concatenate([shingles(t, shingle) for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["h"])

    sample = texts.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0)
    counted = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 3")
    top = counted.orderBy(F.desc("c"), "h").limit(FREQUENT).toArrow()
    h, c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def marks(texts: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """``row, n, digest, sketch, wide, fp`` (the fingerprint) of each row's set, and ``prefix``, the shingles by which it meets others, in its order."""
    known = texts.sparkSession.sparkContext.broadcast(frequent(texts, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, counts = known.value

        def prefix(h: np.ndarray) -> bytes:
            if len(often):
                i = np.minimum(np.searchsorted(often, h), len(often) - 1)
                h = h[np.lexsort((h, np.where(often[i] == h, counts[i], 0)))]
            return h[: len(h) + (-num * len(h) // den) + 1].tobytes()

        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                h = shingles(t, shingle)
                out.append((len(h), xxhash.xxh3_128_digest(h.tobytes()), sketch(h), wide(h), prefix(h), majority(h)))
            *columns, fps = zip(*out, strict=True) if out else ((),) * 6
            given = (pa.array(x, k) for x, k in zip(columns, (pa.int32(), *[pa.binary()] * 4), strict=True))
            yield pa.RecordBatch.from_arrays([b.column("row"), *given, pa.array(np.array(fps, np.uint64).view(np.int64))], ["row", "n", "digest", "sketch", "wide", "prefix", "fp"])

    return texts.mapInArrow(run, MARKS)


def prefixes(marked: DataFrame) -> DataFrame:
    """``h, row, n, at``: the shingles by which each set meets others, and their places in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.frombuffer(x, np.int64) for x in b.column("prefix").to_pylist()]
            if found:
                size = np.array([len(x) for x in found])
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                row, n = (np.repeat(b.column(c).to_numpy(), size) for c in ("row", "n"))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(row), pa.array(n), pa.array(at.astype(np.int32))], ["h", "row", "n", "at"])

    return marked.select("row", "n", "prefix").mapInArrow(run, "h long, row long, n int, at int")


def meetings(prefix: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of buckets of more than one, with the row before (``before``) and the first of a close size (``hub``); null for itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last row so far: its hash, row, size and place, its hub and the hub's size, its neighbour, and whether it has been sent.
        h0 = row0 = n0 = at0 = hub = hub_n = before0 = None
        sent = True
        for b in batches:
            out: list[tuple] = []
            for h, row, n, at in zip(*(b.column(c).to_pylist() for c in ("h", "row", "n", "at")), strict=True):
                if h == h0:
                    if not sent:
                        out.append((h0, row0, n0, at0, None, before0))
                    if den * hub_n < num * n:
                        hub, hub_n = row, n
                    near = row0 if den * n0 >= num * n else None
                    out.append((h, row, n, at, None if hub == row else hub, near))
                    sent, before0 = True, near
                else:
                    hub, hub_n, before0, sent = row, n, None, False
                h0, row0, n0, at0 = h, row, n, at
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["h", "row", "n", "at", "hub", "before"])

    return prefix.repartition("h").sortWithinPartitions("h", "n", "row").mapInArrow(run, SHARED)


def simhash_pairs(marked: DataFrame) -> DataFrame:
    """``u, v``: each row with the first of its fingerprint, and the first ones of fingerprints that the search links."""
    first = materialize(marked.groupBy("fp").agg(F.min("row").alias("first")), "shingle-fp")
    equal = marked.select("row", "fp").join(first, "fp").where(F.col("row") != F.col("first")).select(F.col("row").alias("u"), F.col("first").alias("v"))
    a, b = (first.select(F.col("fp").alias(c), F.col("first").alias(f"r{c}")) for c in "uv")
    near = near_links(first.select("fp"), RADIUS).distinct().join(a, "u").join(b, "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
    return equal.unionByName(near)


def confirmed(pairs: DataFrame, marked: DataFrame, texts: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (``u, v``) that are similar enough, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(den * common >= num * (len(both) - common))
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            differ = np.fromiter(map(differing, b.column("x").to_pylist(), b.column("y").to_pylist()), np.int64, b.num_rows)
            ok = (num + den) * differ <= (den - num) * b.column("total").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    # Sketches first, so that whole sets travel only for pairs that can be similar.
    x, y = (marked.select(F.col("row").alias(c), F.col("wide").alias(d), F.col("n").cast("long").alias(f"n{d}")) for c, d in (("u", "x"), ("v", "y")))
    pairs = pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y", (F.col("nx") + F.col("ny")).alias("total")).mapInArrow(near, PAIR)
    pairs = materialize(pairs, "shingle-near")
    # As a table, its size is known, so that Spark needn't shuffle all texts where it is small.
    needed = materialize(pairs.select(F.explode(F.array("u", "v")).alias("row")).distinct(), "shingle-needed")
    few = materialize(shingle_sets(texts.join(needed, "row", "left_semi"), shingle), "shingle-few")
    x, y = (few.select(F.col("row").alias(c), F.col("hashes").alias(d)) for c, d in (("u", "x"), ("v", "y")))
    found = materialize(pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(run, PAIR), "shingle-links")
    release(pairs)
    release(few)
    return found


def apart(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of ``rows`` (``h, row, n, at, root, sketch``) of a bucket and different roots that no bound rules out."""

    def close(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        (n1, at1, root1, s1), (n2, at2, root2, s2) = ((x[0][:, None], x[1][:, None], x[2][:, None], x[3]) if k == 0 else (x[0][None], x[1][None], x[2][None], x[3]) for k, x in enumerate((a, b)))
        total = n1 + n2
        most = np.minimum(at1, at2) + 1 + np.minimum(n1 - at1, n2 - at2) - 1
        ok = (root1 != root2) & ((num + den) * most >= num * total)
        i, j = np.nonzero(ok)
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            differ = np.bitwise_count(s1[p] ^ s2[q]).sum(1, dtype=np.int64)
            ok[p, q] = (num + den) * differ <= (den - num) * (a[0][p] + b[0][q])
        return np.nonzero(ok)

    def of(bucket: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        # Sorted by size: a block meets those behind it until they are too large.
        row, n = bucket[0], bucket[1]
        for i in range(0, len(row), BLOCK):
            a = [x[i : i + BLOCK] for x in bucket[1:]]
            for j in range(i, len(row), BLOCK):
                if num * n[j] > den * a[0][-1]:
                    break
                p, q = close(a, [x[j : j + BLOCK] for x in bucket[1:]])
                u, v = row[i + p], row[j + q]
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = None, np.zeros(0, np.int64)
        for b in batches:
            columns = [b.column(c).to_numpy() for c in ("row", "n", "at", "root")]
            columns[1:3] = [x.astype(np.int64) for x in columns[1:3]]
            columns.append(np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint64).reshape(b.num_rows, BITS // 64))
            held = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
            key = np.concatenate([key, b.column("h").to_numpy()])
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()]
            for s, e in zip(cuts, cuts[1:], strict=False):
                yield from of([x[s:e] for x in held])
            held, key = [x[cuts[-1] :] for x in held], key[cuts[-1] :]
        if len(key):
            yield from of(held)

    return rows.repartition("h").sortWithinPartitions("h", "n", "row").select("h", "row", "n", "at", "root", "sketch").mapInArrow(run, PAIR)


def group_links(marked: DataFrame, texts: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """``node, root`` of the rows of ``marked`` that links connect."""
    shared = materialize(meetings(prefixes(marked), num, den), "shingle-shared")
    first = shared.select(F.col("row").alias("u"), F.explode(F.array_compact(F.array("hub", "before"))).alias("v")).unionByName(simhash_pairs(marked))
    first = materialize(first.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "shingle-pairs")
    roots = materialize(components(confirmed(first, marked, texts, shingle, num, den)), "shingle-roots")
    placed = shared.join(roots, F.col("row") == F.col("node"), "left").select("h", "row", "n", "at", F.coalesce("root", "row").alias("root"))
    placed = materialize(placed, "shingle-placed")
    release(shared)
    mixed = placed.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("h")
    left = placed.join(mixed, "h", "left_semi").join(marked.select("row", "sketch"), "row")
    second = materialize(apart(left, num, den).distinct().join(first, ["u", "v"], "left_anti"), "shingle-pairs")
    release(placed)
    # Links of the first pass go on as one per member.
    every = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(confirmed(second, marked, texts, shingle, num, den))
    return components(every)


def one_per_group(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """``docs`` with one row of each group; ``similarity`` is a fraction."""
    num, den = similarity
    # Written once, so that numbers stay with their rows.
    numbered = docs.select(F.struct(*map(named, docs.columns)).alias("document"), F.monotonically_increasing_id().alias("row"))
    numbered = materialize(numbered, "shingle-rows")
    texts = numbered.select("row", F.col("document").getField(text).cast("binary").alias("text"))
    every = materialize(marks(texts, shingle, num, den), "shingle-marks")
    classes = every.groupBy("digest").agg(F.min("row").alias("leader"), F.count(F.lit(1)).alias("c")).where("c > 1")
    again = every.select("row", "digest").join(classes, "digest").where(F.col("row") != F.col("leader")).select("row", "leader")
    again = materialize(again, "shingle-equal")
    roots = group_links(every.join(again.select("row"), "row", "left_anti"), texts, shingle, num, den)
    links = again.select(F.col("row").alias("node"), F.col("leader").alias("by")).join(roots.select(F.col("node").alias("by"), "root"), "by", "left").select("node", F.coalesce("root", "by").alias("root"))
    members = materialize(roots.select("node", "root").unionByName(links), "shingle-members")
    release(every)
    members = members.unionByName(members.select(F.col("root").alias("node"), "root")).distinct()
    ids = members.join(numbered.select(F.col("row").alias("node"), F.col("document").getField(id).alias("id")), "node")
    first = ids.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "node"))["node"].alias("node"))
    gone = members.select("node").distinct().join(first.select("node"), "node", "left_anti").withColumnRenamed("node", "row")
    return numbered.join(materialize(gone, "shingle-gone"), "row", "left_anti").select("document.*")
