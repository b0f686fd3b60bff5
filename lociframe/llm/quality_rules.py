"""Line-first quality rules, on DataFrame functions only.

Every line is judged by punctuation, navigation and boilerplate rules, failing lines are removed, and a
document that loses too much of its text, boilerplate included, or fails the word and repetition rules, is rejected.
A line is boilerplate where its phrases make up enough of it, one in ``boilerplate_words`` words or more, so that prose
that mentions a licence stays.

Defined results: a null text has no words, fails the rules and has null clean text; an empty text likewise, with empty
clean text; long texts are judged whole, in time that grows with their words (their windows are sorted); an empty table
gives an empty table; repeated rows are judged one by one; every input column is kept, but one named like a result is
replaced by it. No other name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.llm.shared import WHITE, WORD, let, named, once, packed, unpacked

SYMBOL = "[#*$%&|<>]"
# Phrases that mark a line as boilerplate, matched in lower case.
BOILERPLATE = (
    "all rights reserved|licensed under|released under the|terms of (use|service)|privacy policy|"
    "cookie|javascript|lorem ipsum|subscribe to our|click here|copyright|©|"
    "todos los derechos reservados|política de privacidad|aviso legal|bajo licencia|términos de uso|"
    "tous droits réservés|politique de confidentialité|mentions légales|sous licence|conditions d.utilisation|"
    "alle rechte vorbehalten|datenschutzerklärung|impressum|lizenziert unter|nutzungsbedingungen"
)


def _windows(words: Column, width: int) -> Column:
    """Hashes of the windows of ``width`` words, in order; those that begin in the last words are shorter."""
    return F.transform(words, lambda _, i: F.xxhash64(F.slice(words, i + 1, width)))


def _repeat_words(windows: Column, width: int) -> Column:
    """Words inside windows that come twice or more: equal hashes lie together once sorted; their places' union is counted."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

    def places(s: Column) -> Column:
        hash_at = lambda j: F.get(s, j).getField("h")
        found = F.filter(s, lambda x, i: F.coalesce(hash_at(i + 1) == x.getField("h"), F.lit(False)) | F.coalesce(hash_at(i - 1) == x.getField("h"), F.lit(False)))
        return F.sort_array(F.transform(found, lambda x: x.getField("at")))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(let(placed, places), covered)


def _count(line: Column, chars: str) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, chars, ""))


def is_boilerplate(line: Column, words: int = 30) -> Column:
    """Whether boilerplate phrases are one in ``words`` words of the line, or more."""
    low = F.lower(line)
    return low.rlike(BOILERPLATE) & (F.regexp_count(low, F.lit(BOILERPLATE)) * words >= F.size(F.split(line, WHITE)))


def line_fails(line: Column, has_symbols: Column) -> Column:
    """True for a line that the punctuation and navigation rules remove; blank lines never fail.

    ``has_symbols``: whether the text has any symbol at all, so that clean texts skip the counting.
    """
    ends = F.substring(line, F.lit(-1), F.lit(1)).isin(".", "!", "?", "\u2026", "\u3002")
    sentence = ends | line.rlike("[.!?\u2026\u3002][\"'\u00bb\u201d)\\]]*([\\x20\\x09-\\x0D]|$)")
    # A trimmed line of n words has n - 1 runs of white space.
    n = F.size(F.split(line, WHITE))
    symbols = has_symbols & ((_count(line, SYMBOL) * 4 > n) | (line.contains("|") & (_count(line, "\\|") * 4 >= n)))
    shouts = line.contains("!!") & (_count(line, "!") * 2 > n)
    return (~sentence | symbols | shouts) & line.rlike("[^\\x20\\x09-\\x0D]")


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "clean_text", "kept")


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    min_words: int = 10,
    max_repeat_percent: int = 20,
    max_lost_percent: int = 60,
    width: int = 5,
    boilerplate_words: int = 30,
) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``lost_chars``, ``clean_text`` and ``kept``.

    No shuffle: each row is judged on its own. Windows are compared by 64-bit hashes.
    """
    body = F.coalesce(named(text), F.lit(""))
    given = packed(docs, body=body, is_null=named(text).isNull())
    # ASCII white space at both ends off, so that a split has no empty ends.
    trimmed = F.regexp_replace("body", "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", "")
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE))
    # Each step's arrays are columns, since what a lambda uses would otherwise be computed for each element.
    parts = given.withColumns({"words": once(words), "lines": once(F.split("body", "\n")), "n_symbols": F.regexp_count("body", F.lit(SYMBOL)).cast("long")})
    worded = F.filter("lines", lambda x: x.rlike(WORD))
    stays = lambda x: ~(is_boilerplate(x, boilerplate_words) | line_fails(x, F.col("n_symbols") > 0))
    hashed = parts.withColumns(
        {
            "windows": once(F.slice(_windows(F.col("words"), width), F.lit(1), F.greatest(F.size("words") - (width - 1), F.lit(0)))),
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_dup_lines": let(worded, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
            "rest": once(F.array_join(F.filter("lines", stays), "\n")),
        }
    ).drop("words", "lines")
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    counted = hashed.withColumn("n_repeat_words", F.when(again, _repeat_words(F.col("windows"), width)).otherwise(F.lit(0).cast("long"))).drop("windows")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    # Characters outside line ends; removing a line also removes one line end, which isn't counted as lost.
    length = lambda c: F.length(F.replace(F.col(c), F.lit("\n"), F.lit("")))
    counted = counted.withColumns({"base_failed": failed, "own": length("body"), "lost_chars": (length("body") - length("rest")).cast("long"), "clean_text": F.when(~F.col("is_null"), F.col("rest"))})
    enough = (100 * F.col("lost_chars") <= max_lost_percent * F.col("own")) & F.col("rest").rlike(WORD)
    return unpacked(counted.withColumn("kept", ~F.col("base_failed") & enough), *RESULTS)
