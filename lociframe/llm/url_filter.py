"""URL filtering by a sorted digest array.

Rules are host and path prefixes. Their 64-bit XXH64 digests lie in one sorted array that executors map into
memory; a URL's candidate keys (its host suffixes, each with the path prefixes of the lengths that rules have)
are hashed in the JVM, probed with vectorised binary search, and confirmed against the stored strings, so a
digest collision can't decide.

The index is written to the shared folder and shipped with ``SparkContext.addFile``; each executor, also one
that joins later, fetches its own copy and maps it. It grows with the rules, not with the URLs.

Defined results: a null URL, or one without ``://``, has an empty host and path and gets the default verdict;
repeated rows are judged one by one; of a long host only suffixes of as many labels as a rule has are looked up; an
empty table gives an empty table; other columns pass through, whatever their names, but those named like a result are
replaced.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociframe.llm.shared import lower_ascii, named, packed, shared_dir, unpacked

SEED = 42  # of Spark's own xxhash64
Rule = tuple[str, str, str]  # host, path prefix, verdict


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    return lower_ascii(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)


def build_index(rules: Sequence[Rule]) -> bytes:
    """Header, sorted digests, verdict codes, string ends and the strings ``host + path`` in digest order."""
    rows = sorted({(xxhash.xxh64_intdigest((h + p).encode(), SEED), h + p, v) for h, p, v in rules})
    strings = [r[1].encode() for r in rows]
    return b"".join(
        (
            struct.pack("<Q", len(rows)),
            np.array([r[0] for r in rows], "<u8").tobytes(),
            np.array([r[2] == "block" for r in rows], "<u8").tobytes(),
            np.cumsum([0, *map(len, strings)]).astype("<u8").tobytes(),
            *strings,
        )
    )


class MappedIndex:
    """Memory-mapped view of ``build_index``'s bytes."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, mode="r")
        n = int(raw[:8].view("<u8")[0])
        at = 8 + 8 * n
        self.digests, self.block, self.ends = raw[8:at].view("<u8"), raw[at : at + 8 * n].view("<u8"), raw[at + 8 * n : at + 16 * n + 8].view("<u8")
        self.strings = raw[at + 16 * n + 8 :]

    def string(self, i: int) -> str:
        return self.strings[int(self.ends[i]) : int(self.ends[i + 1])].tobytes().decode()

    def probe(self, digests: np.ndarray, keys: pa.Array) -> np.ndarray:
        """Index of each confirmed key, -1 where there is none."""
        found = np.full(len(digests), -1, np.int64)
        if not len(self.digests):
            return found
        at = np.searchsorted(self.digests, digests)
        hit = np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == digests)
        for i, key in zip(hit, keys.take(pa.array(hit)).to_pylist(), strict=True):
            j = at[i]
            while j < len(self.digests) and self.digests[j] == digests[i]:  # equal digests lie together
                if self.string(j) == key:
                    found[i] = j
                    break
                j += 1
        return found


def publish(spark: SparkSession, index: bytes) -> str:
    """Puts the index into the shared folder and hands it to the executors; its file name."""
    name = f"url-rules-{uuid.uuid4().hex}.idx"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(index)
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def url_filter(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``. The longest fitting rule wins; of two as long, the one with the longer host."""
    spark = pages.sparkSession
    name = publish(spark, build_index(rules))
    lengths = sorted({len(p) for _, p, _ in rules})
    host, path = host_and_path(named(url))
    labels = F.split("host", "\\.")
    # No rule fits a suffix of more labels than the longest rule has.
    most = max((h.count(".") + 1 for h, _, _ in rules), default=1)
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - (most - 1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_distinct(F.array(*[F.substring(F.col("path"), F.lit(1), F.lit(n)) for n in lengths])) if lengths else F.array().cast("array<string>")
    # The longest key first; the stable order keeps the longer host first among equals.
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    cand = packed(pages, host=host, path=path).withColumn("_keys", F.array_sort(keys, lambda a, b: F.length(b) - F.length(a)))
    cand = cand.withColumn("_digests", F.transform("_keys", lambda k: F.xxhash64(k)))
    kept = ["row", "host", "path"]
    schema = T.StructType([cand.schema[c] for c in kept] + [T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = MappedIndex(SparkFiles.get(name))
        for b in batches:
            digests, keys = b.column("_digests"), b.column("_keys")
            flat = digests.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            found = index.probe(flat, keys.flatten())
            row = np.repeat(np.arange(b.num_rows), np.diff(digests.offsets.to_numpy()))
            hits = np.flatnonzero(found >= 0)
            first = np.full(b.num_rows, -1, np.int64)
            first[row[hits][::-1]] = found[hits][::-1]  # the earliest candidate is written last
            rule = pa.array([index.string(i) if i >= 0 else None for i in first], pa.string())
            verdict = pa.array([default if i < 0 else "block" if index.block[i] else "allow" for i in first], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [rule, verdict], [*kept, "rule", "verdict"])

    return unpacked(cand.select(*kept, "_keys", "_digests").mapInArrow(judge, schema), "host", "path", "rule", "verdict")
