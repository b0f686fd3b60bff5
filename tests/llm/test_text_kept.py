"""Texts that must not be lost or left: broken markup, and passages that a cut brings together."""

from __future__ import annotations

import random
import re
import time

import pytest

from lociframe.llm import chat, decontaminate, html_extract


def texts(page):
    return [b.text for b in html_extract.leaf_blocks(page)]


@pytest.mark.parametrize("element", ["<svg class='i'/>", "<iframe src=x />", "<object data=y>", "<svg>", "<select><option>", "<noscript>", "<textarea />"])
def test_elements_without_an_end(element):
    assert texts(f"<article><p>A</p>{element}<p>B</p></article>")[:2] == ["A", "B"]


def test_elements_with_an_end():
    assert texts("<p>A</p><svg><text>no</text></svg><p>B</p><iframe>no</iframe>C<script>no</script ><p>D") == ["A", "B", "C", "D"]
    assert texts("<p>A</p><style>p {") == texts("<p>A</p><script>x <p>B</p>") == ["A"]


def test_tags_without_an_end():
    assert texts("<p>a <b and c") == ["a <b and c"]
    assert texts("<p title='x>y'>a</p> isn't <p>b</p> don't") == ["a", "isn't", "b", "don't"]
    assert texts("a < b > c <5> </> d") == ["a < b > c <5> </> d"]


@pytest.mark.parametrize("part", ["<a b", '<a b="', "<a b='", "<svg>", "<iframe src=x>", "<a", "</svg", "<a\n=", "<a b=\"'\" c='\"' ", "<!-", "<p><span>"])
@pytest.mark.parametrize("tail", ["", ">"])
def test_time_grows_with_the_length(part, tail):
    page = part * (1_000_000 // len(part)) + tail
    began = time.process_time()
    html_extract.leaf_blocks(page)
    assert time.process_time() - began < 8


def test_deep_pages_of_many_classes():
    crf = html_extract.trained(400, 0)
    page = "".join(f"<div class={'abcdefgh'[i % 8] * (i % 97 + 1)}>Text {i}." for i in range(20_000))
    began = time.process_time()
    html_extract.extract(page, crf)
    assert time.process_time() - began < 20


def test_the_review_example(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x y a b c d e a b c d e f g h i j f g h i j z")], "doc_id long, text string")
    assert decontaminate.decontaminate(docs, bench).first()["text"] == "x y z"


@pytest.mark.parametrize("block", [8 << 20, 100])
def test_nothing_is_hit_after_a_cut(spark, block):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choices("abc", k=n))
    items = [(k, text(rng.choice([2, 3, 5, 7]))) for k in range(5)]
    docs = [(k, text(rng.randrange(80))) for k in range(60)] + [(100, "clean words here"), (101, None), (102, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    out = decontaminate.decontaminate(df, bench, width=5, block_bytes=block)
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    again = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert decontaminate.contamination(again, bench, width=5).where("n_hit > 0").count() == 0
    assert {k: rows[k] for k in (100, 101, 102)} == {100: "clean words here", 101: None, 102: ""}

    windows = {tuple(w[k : k + n]) for _, t in items for w in [t.split()] for n in [min(5, len(w))] for k in range(len(w) - n + 1)}
    for k, t in docs[:60]:
        words = re.findall("[a-z]+", t)
        while True:
            hit = {p + x for n in {len(w) for w in windows} for p in range(len(words) - n + 1) if tuple(words[p : p + n]) in windows for x in range(n)}
            if not hit:
                break
            words = [w for p, w in enumerate(words) if p not in hit]
        assert rows.get(k, "").split() == words


def test_chat_rows_without_an_id(spark):
    """Rows of no conversation are one conversation, as those of any other id."""
    rows = [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (1, 0, "user", "long " * 200_000), (1, 1, "assistant", "End.")]
    out = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (out[None]["n_turns"], out[None]["valid"], out[1]["n_turns"]) == (2, True, 2)
    assert len(out[1]["segments"][1]["text"]) == 1_000_000
