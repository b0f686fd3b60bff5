"""Spelling variants of frequent words, by permuterm rotations.

Words are counted over all texts. Two are near if one code point is inserted, deleted or replaced; a word's form is its
near word of the largest count, if that is at least twice its own, and its root is the last of the forms that follow.

Method: a word marked with a terminator is written from each of its places on, ``B$A`` for ``A B``. With the code point
``c`` at the cut left out, a rotation of ``A c B`` becomes ``B$A`` too. So words that begin with the same rotation and
one more code point differ there by a replacement, and a word that is that rotation differs from them by an indel. All rotations
are sorted by range; each run of an equal rotation is scanned once, and gives each of its words the number of its
neighbours and the best one instead of all pairs. A replacement shows in one rotation only; of the rotations of an indel in
a run of equal letters the first counts.

A run holds one word for each letter and one without, so it is at most as long as the alphabet, whatever the corpus.
Counts are added up within each batch of texts before the shuffle. Roots follow by pointer jumping: counts at least
double from form to form, so few rounds are needed; a round is a join and is written.

Defined results: null and empty texts have no words; long texts are taken whole; a null id reads as an empty one in the rows' hash; repeated
rows count again; ties go to the smallest word in code-point order; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociframe.llm.shared import materialize, named

RUN = re.compile("[a-zÀ-ÿ]+")
END = "$"


def counted(docs: DataFrame, id: str = "doc_id", text: str = "text", least_letters: int = 5, changed: Callable[[bytes, str], str] | None = None) -> DataFrame:
    """``word, n`` of the runs of letters of all texts, A-Z lower-cased; ``changed(id, run)`` may give another word for a document's run."""
    source = docs.select(F.coalesce(named(id).cast("string"), F.lit("")).alias("id"), named(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: Counter[str] = Counter()
            for key, raw in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if not raw:
                    continue
                # Of bytes, so A-Z only.
                own = Counter(w for w in RUN.findall(raw.lower().decode()) if len(w) >= least_letters)
                if changed is None:
                    total.update(own)
                    continue
                key = key.encode()
                for w, n in own.items():
                    total[changed(key, w)] += n
            words = [w for w in total if len(w) >= least_letters]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([total[w] for w in words], pa.int64())], ["word", "n"])

    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
    return source.mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))


def misspelt(key: bytes, word: str) -> str:
    """``word``, of one in 97 documents without one letter, by crc32 of ``id:word``."""
    h = zlib.crc32(word.encode(), zlib.crc32(key + b":"))
    if h % 97:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def rotations(words: DataFrame) -> DataFrame:
    """``key, word, n, cut``: each rotation of a marked word (``cut`` null), and each with the letter at its end left out.

    ``cut`` says whether leaving it out counts as the deletion: in a run of equal letters, that of the first does.
    """
    w, k = F.col("word"), F.col("k")
    length = F.length(w)
    each = words.select("word", "n", F.explode(F.sequence(F.lit(0), length)).alias("k"))
    head, letter, tail = F.substring(w, F.lit(1), k), F.substring(w, k + 1, F.lit(1)), F.substring(w, k + 2, length)
    before = F.substring(w, k, F.lit(1))
    whole = each.select(F.concat(letter, tail, F.lit(END), head).alias("key"), "word", "n", F.lit(None).cast("boolean").alias("cut"))
    without = each.where(k < length).select(F.concat(tail, F.lit(END), head).alias("key"), "word", "n", ((k == 0) | (letter != before)).alias("cut"))
    return whole.unionByName(without)


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n_near, best`` of words with neighbours: ``best`` is a struct of count and word."""
    sorted_rows = rotations(words).repartitionByRange("key")
    # In a run: the rotated word itself, if there is one, and the words with one more letter, the best first.
    run = Window.partitionBy("key")
    best_first = run.orderBy(F.col("cut").isNull(), F.col("n").desc(), F.col("word")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pair = lambda on: F.when(on, F.struct("n", "word"))
    is_cut = F.col("cut").isNotNull()
    seen = sorted_rows.withColumns(
        {
            "cuts": F.count_if(is_cut).over(run),
            "deletions": F.count_if(F.coalesce("cut", F.lit(False))).over(run),
            "itself": F.max(pair(~is_cut)).over(run),
            "first": F.first(pair(is_cut), ignorenulls=True).over(best_first),
            "second": F.nth_value(pair(is_cut), 2).over(best_first),
            "longest": F.first(pair(F.col("cut")), ignorenulls=True).over(best_first),
        }
    )
    replaced = seen.where(is_cut & (F.col("cuts") > 1)).select("word", (F.col("cuts") - 1).alias("near"), F.when(F.col("first.word") == F.col("word"), F.col("second")).otherwise(F.col("first")).alias("best"))
    shorter = seen.where(F.col("cut") & F.col("itself").isNotNull()).select("word", F.lit(1).cast("long").alias("near"), F.col("itself").alias("best"))
    longer = seen.where(~is_cut & (F.col("deletions") > 0)).select("word", F.col("deletions").alias("near"), F.col("longest").alias("best"))
    every = replaced.unionByName(shorter).unionByName(longer).select("word", "near", "best", (-F.col("best.n")).alias("rank"), F.col("best.word").alias("other"))
    return every.groupBy("word").agg(F.sum("near").alias("n_near"), F.min_by("best", F.struct("rank", "other")).alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """``word, root`` of words with a ``form``: the word at which the forms that follow end."""
    roots = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "spelling-roots")
    while roots.where("open").limit(1).count():
        ahead = roots.select(F.col("word").alias("_w"), F.col("root").alias("_next"))
        met = roots.join(ahead, F.col("root") == F.col("_w"), "left")
        roots = materialize(met.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("open")), "spelling-roots")
    return roots.select("word", "root")


def variants(words: DataFrame) -> DataFrame:
    """``words`` (``word, n``) with ``form, root, n_near, form_n``."""
    words = materialize(words.select("word", "n"), "spelling-words")
    near = neighbours(words).withColumnRenamed("word", "_near")
    good = F.col("best.n") >= 2 * F.col("n")
    met = words.join(near, F.col("word") == F.col("_near"), "left")
    formed = materialize(
        met.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.word")).alias("form"), F.when(good, F.col("best.n")).alias("form_n")), "spelling-forms"
    )
    roots = last_forms(formed.where("form is not null")).withColumnRenamed("word", "_word")
    return formed.join(roots, F.col("word") == F.col("_word"), "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
