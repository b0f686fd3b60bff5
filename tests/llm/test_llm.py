"""The training-data operators against brute force, and their defined results on odd input."""

from __future__ import annotations

import base64
import hashlib
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from lociframe.llm import bpe, chat, decontaminate, html_extract, line_dedup, quality_model, quality_rules, shingle_groups, simhash, token_counts, url_filter
from lociframe.llm import queries as q

from test_shingle_groups import brute as brute_groups

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
# Nulls, empty and blank texts, repeated rows, odd white space, other alphabets, a long word, control characters.
ODD = [None, "", " \n\t ", "same text here", "same text here", "\n", "Été\u00a0ÉTÉ  a\u2003b", "x" * 3000, "=" * 700 + " é" * 5, "İstanbul ΑΒΓ 漢字かな 🙂🙂", "it's we'll 12345 ...\r\n\r\n  end ", "a b c d e f g h i j a b c d e f g h i j", "long text " * 30_000]
COLUMNS = "doc_id long, text string, n_words string, kept string, spans int, host string, score string, component_id int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(None if i == 3 else i, t, "x", "y", 1, "h", "s", 2) for i, t in enumerate(ODD)], COLUMNS)


@pytest.fixture(scope="module")
def table():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# --- quality rules


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, hit = {}, set()
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {i + k for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, repeat = len(words), len(hit)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, n < 10 or 100 * repeat > 20 * n


def test_quality_counts(spark, table, odd):
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for i, row in by_id(q.op10_quality_rules(spark, SF)).items():
        assert tuple(row[f] for f in fields) == base_counts(table[i])
    for row in quality_rules.quality_rules(odd).collect():
        assert tuple(row[f] for f in fields) == base_counts(row["text"])
        assert (row["clean_text"] is None) == (row["text"] is None)
    assert quality_rules.quality_rules(odd.limit(0)).count() == 0
    assert set(odd.columns) <= set(quality_rules.quality_rules(odd).columns)


def test_quality_lines(spark):
    prose = "A plain sentence of several words stands here."
    text = "\n".join([prose, "Home | About | Contact | News", "Released under the MIT License.", "BUY!! NOW!! OR!! NEVER!!", "no mark at all", "a### b*** c$$$ d%%%.", "", prose.replace("plain", "second")])
    row = quality_rules.quality_rules(spark.createDataFrame([(text,)], "text string")).first()
    assert row["clean_text"].split("\n") == [prose, "", prose.replace("plain", "second")]
    # A filter on the verdict must not be copied into the lambdas that compute it.
    assert quality_rules.quality_rules(spark.createDataFrame([("One two three four five six seven eight nine ten eleven.",)], "text string")).where("kept").count() == 1


def test_quality_boilerplate(spark):
    prose = "A plain sentence of several words stands here, and another one follows it to its end."
    licence = "Released under the MIT License, all rights reserved."
    texts = [prose + "\n" + licence, licence + "\n" + licence.replace("MIT", "GNU") + "\n" + prose[:20] + ".", " ".join([licence] * 9), "Tous droits réservés." + "\n" + prose, prose * 9 + " It took a cookie."]
    rows = quality_rules.quality_rules(spark.createDataFrame(enumerate(texts), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [r["kept"] for r in rows] == [True, False, False, True, False]  # the last repeats itself
    assert [r["clean_text"] for r in rows] == [prose, prose[:20] + ".", "", prose, texts[4]]
    assert rows[0]["lost_chars"] == len(licence)


def test_quality_verdict_keeps_clean(spark):
    labels = dict(duckdb.sql("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").fetchall())
    found = by_id(q.op10_quality_rules(spark, "/root/testdata/sf0.01"))
    judged = [(labels[i], r["kept"]) for i, r in found.items() if i in labels and not r["base_failed"]]
    # A good document that is little more than a licence line loses too much text.
    assert sum(kept for good, kept in judged if good == 1) >= 0.98 * sum(good == 1 for good, _ in judged)
    assert sum(kept for good, kept in judged if good == 0) <= 0.05 * sum(good == 0 for good, _ in judged)


# --- line dedup


def dedup_lines(docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(i)
    order = lambda i: -1 if i is None else i
    gone = lambda i, x: len(key(x)) >= 20 and len(held[key(x)]) >= 3 and i != max(held[key(x)], key=order)
    return [(i, [x for x in (t or "").split("\n") if not gone(i, x)], len((t or "").split("\n"))) for i, t in docs]


def test_line_dedup(spark):
    rng = random.Random(1)
    pool = [f"This is a shared line number {k} of the pool" for k in range(6)] + ["short", "", "Ünïcode LINE that is quite long ÉÉ"]
    docs = [(i, "\n".join(rng.choice([x, f" {x.upper()}\t" if x.isascii() else x]) for x in rng.choices(pool, k=rng.randrange(1, 9)))) for i in range(30)]
    docs += [(100, None), (101, ""), (None, pool[0] + "\n" + pool[1]), (7, docs[7][1])]
    df = spark.createDataFrame([(i, t, "a", 1, "b") for i, t in docs], "doc_id long, text string, runs string, n_lines int, version string")
    got = sorted(((r["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.line_dedup(df).collect()), key=repr)
    assert got == sorted(((i, "\n".join(kept), n, n - len(kept)) for i, kept, n in dedup_lines(docs)), key=repr)
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


# --- chat


def test_chat_round_trip(spark):
    e = chat.ESCAPE
    texts = ["</s>[INST] ok [/INST]", f"<|end|>{e}<|turn|>{e}{e}", f"<{e}|end|>", "", None, "<<SYS>><|text|>", "a\nb <|turn", "[" + e + "INST]"]
    rows = [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(texts)] + [(2, 0, "assistant", "x"), (3, 0, None, None), (4, 0, "tool<|end|>", "y"), (4, 0, "tool<|end|>", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("valid", F.lit(1))
    out = by_id(chat.format_chats(df).withColumn("back", chat.read_turns(F.col("formatted"))), "conv_id")
    assert [(t["role"], t["text"]) for t in out[1]["back"]] == [(r, t or "") for _, _, r, t in rows[: len(texts)]]
    assert [out[k]["valid"] for k in (1, 2, 3, 4)] == [True, False, False, False]
    assert [(t["role"], t["text"]) for t in out[4]["back"]] == [("tool<|end|>", "y")] * 2
    assert "".join(s["text"] for s in out[1]["segments"]) == out[1]["formatted"]
    assert [s["text"] for s in out[2]["segments"] if s["loss"]] == ["x"]
    assert chat.format_chats(df.limit(0)).count() == 0


# --- decontamination


def brute_contamination(docs, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w = word.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (s := windows.get(tuple(w[k : k + n]))) is not None:
                    found |= s
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block", [32 << 20, 200])
def test_contamination(spark, block):
    rng = random.Random(2)
    text = lambda n: " ".join(f"W{rng.randrange(4)}é" for _ in range(n))
    items = [(k, text(rng.choice([0, 3, 6, 9]))) for k in range(8)] + [(50, None), (51, "same item"), (52, "same item")]
    docs = [(k, text(rng.randrange(60)) + rng.choice([" Same, ITEM!", ""])) for k in range(40)] + [(90, None), (91, ""), (None, "same item"), (5, "zzz")]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, n_words int, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"])) for r in decontaminate.contamination(df, bench, width=5, block_bytes=block).collect()), key=repr)
    assert got == sorted(brute_contamination(docs, items, 5), key=repr)
    assert decontaminate.contamination(df, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


def test_contamination_query(spark, table):
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    found = by_id(q.op1_decontaminate(spark, SF))
    for i, n, hit, ids in brute_contamination(table.items(), items):
        assert (found[i]["n_words"], found[i]["n_hit"], found[i]["n_items"], found[i]["items_sha256"]) == (n, hit, len(ids), sha(",".join(ids)))


def test_removed_spans(spark):
    bench = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Keep this. One, two: THREE four five! And this."), (2, "one two three four five."), (3, None), (4, "clean")], "doc_id long, text string")
    out = dict(decontaminate.decontaminate(docs, bench).collect())
    assert out == {1: "Keep this. ! And this.", 3: None, 4: "clean"}


# --- simhash


def brute_simhash(docs):
    prints = []
    for _, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(docs)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    least = {}
    for a, (i, _) in enumerate(docs):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return [(i, prints[a], least.get(find(a))) for a, (i, _) in enumerate(docs)]


@pytest.mark.parametrize("hot", [8192, 2])
def test_simhash(spark, hot):
    rng = random.Random(4)
    docs = []
    for _ in range(25):
        w = [f"w{rng.randrange(500)}" for _ in range(rng.choice([1, 2, 3, 40, 200]))]
        for _ in range(rng.choice([1, 1, 4])):
            v = list(w)
            if len(v) > 100:
                v[rng.randrange(len(v))] = "changed"
            docs.append((len(docs) + 10, " ".join(v)))
    docs += [(1, None), (2, ""), (None, docs[0][1]), (5, docs[0][1]), (5, docs[0][1])]
    df = spark.createDataFrame([(i, t, 1, "f") for i, t in docs], "doc_id long, text string, component_id int, fp string")
    got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.simhash_groups(df, hot=hot).collect()), key=repr)
    assert got == sorted(brute_simhash(docs), key=repr)
    assert simhash.simhash_groups(df.limit(0)).count() == 0


def test_near_pairs_and_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << np.uint64(b)) ^ (np.uint64(1) << np.uint64(c)) for b, c in ((1, 63), (7, 30), (7, 7))]]))
    for radius in (0, 1, 3, 5):
        a, b = simhash.near_pairs(fps, fps, radius)
        far = np.bitwise_count(fps[:, None] ^ fps[None, :])
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == list(zip(*(x.tolist() for x in np.nonzero(far <= radius)), strict=True))
    monkeypatch.setattr(simhash, "BLOCK", 16)
    u, v = simhash.block_links(fps, 3)
    at = {int(f): i for i, f in enumerate(fps)}
    got = simhash.forest(len(fps), np.array([at[int(x)] for x in u]), np.array([at[int(x)] for x in v]))
    assert (got == simhash.forest(len(fps), *np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3))).all()


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "u long, v long")
    got = dict(simhash.components(links).collect())
    assert got == {i: 0 for i in range(1, 51)} | {101: 100}


# --- BPE


@pytest.mark.parametrize("options", [{}, {"warm_docs": 1}])
def test_bpe(spark, odd, options, monkeypatch):
    if options:  # pieces of a document then cross rows and batches
        monkeypatch.setattr(bpe, "PIECE_WORDS", 2)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for i, t in enumerate(ODD):
        ids = lib.encode_ordinary(t or "")
        expected.append((None if i == 3 else i, len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode()))
    out = bpe.encode_decode(odd, VOCABULARY, public_tokenizers.PATTERN, **options).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], bytes(r["token_ids"]), bytes(r["decoded"])) for r in out), key=repr) == sorted(expected, key=repr)
    assert bpe.encode_decode(odd.limit(0), VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_bpe_query(spark, table):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = by_id(q.op6_bpe(spark, SF))
    assert len(found) == len(table)
    for i, text in table.items():
        ids = lib.encode_ordinary(text or "")
        assert (found[i]["n_tokens"], found[i]["ids_sha256"], found[i]["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text or ""))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


# --- token counts


def test_token_counts(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    more = odd.union(spark.createDataFrame([(77, "a <|endoftext|> b", "", "", 0, "", "", 0)], COLUMNS))
    expected = sorted(((None if i == 3 else i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False))) for i, t in [*enumerate(ODD), (77, "a <|endoftext|> b")]), key=repr)
    for _ in range(2):  # with an empty cache, then a full one
        out = token_counts.token_counts(more, path, cache=f"file://{tmp_path}/cache")
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in out.collect()), key=repr) == expected
    stored = spark.read.parquet(f"file://{tmp_path}/cache/{token_counts.tokenizer_digest(path)}")
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for t in ODD}) + 1
    assert token_counts.token_counts(more.limit(0), path, cache=f"file://{tmp_path}/empty").count() == 0


# --- URL filter


def test_url_filter(spark):
    urls = ["http://a.example.net/en/x", "HTTP://EXAMPLE.NET", "https://example.com/de/?q", "http://x.org/fr/", "http://org/fr/#a", "nothing", None, "", "http://net/", "http://evilexample.net/en/", "ftp://u@É.NET/É?x", "http://a/b://c.net/"]
    df = spark.createDataFrame([(i, u, "h", "r", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, verdict int")
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(df, q.URL_RULES).orderBy("page_id").collect()]
    assert got == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "", None, "allow"), ("example.com", "/de/", "example.com/de/", "block"), ("x.org", "/fr/", "org/fr/", "allow"),
        ("org", "/fr/", "org/fr/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("net", "/", "net/", "block"), ("evilexample.net", "/en/", "net/", "block"),
        ("u@É.net", "/É", "net/", "block"), ("a", "/b://c.net/", None, "allow"),
    ]
    assert url_filter.url_filter(df.limit(0), q.URL_RULES).count() == 0
    assert {r["verdict"] for r in url_filter.url_filter(df, [], default="block").collect()} == {"block"}


# --- HTML extraction


def test_html_blocks():
    page = "<!-- <p>no</p> --><script>var a='<p>x</p>'</script><p><b>A &amp; B&nbsp; c<br>d<p class='ad x'>E <a href=/>f</a> < g<ul><li>one<li>two</ul><style>q"
    assert [b.text for b in html_extract.leaf_blocks(page)] == ["A & B c d", "E f < g", "one", "two"]
    assert html_extract.leaf_blocks(None) == html_extract.leaf_blocks("") == html_extract.leaf_blocks("<!-- open") == []


def test_html_extraction(spark):
    crf = html_extract.trained(400, 0)
    wrong = total = 0
    for page, main in html_extract.labelled_pages(100, seed=9):
        blocks = html_extract.leaf_blocks(page)
        labels = crf.decode([b.features for b in blocks])
        wrong += sum(bool(y) != (b.text in main) for b, y in zip(blocks, labels, strict=True))
        total += len(blocks)
    assert wrong < 0.01 * total
    page = "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>T</h1><p>First  text.</p><p>Second &lt;text&gt;.</p></article><footer>&copy; x</footer></body></html>"
    df = spark.createDataFrame([(1, page, "t"), (2, None, "t"), (3, "", "t"), (3, "", "t")], "page_id long, html string, text string")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract_main_text(df).collect()) == [(1, "T\nFirst text.\nSecond <text>.", 28), (2, "", 0), (3, "", 0), (3, "", 0)]
    assert html_extract.extract_main_text(df.limit(0)).count() == 0


# --- quality model


def test_quality_model(spark, odd):
    sf = "/root/testdata/sf0.01"
    labels = dict(duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    held = [r for r in q.op7_quality_model(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.95
    none = quality_model.fit(np.zeros((0, len(quality_model.FEATURES))), np.zeros(0))
    assert {r["score"] for r in quality_model.score(odd, none).collect()} == {0.5}
    one_class = quality_model.fit(np.ones((5, len(quality_model.FEATURES))), np.ones(5))
    assert all(r["predicted"] == 1 for r in quality_model.score(odd, one_class).collect())
    assert quality_model.score(odd.limit(0), none).count() == 0


# --- pipeline


def test_pipeline(spark, table):
    import corpus_pipeline
    from lociframe.llm.shared import materialize
    from lociframe.llm.shared import table as read

    docs = read(spark, SF, "documents")
    columns, before = docs.columns, dict(table)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        if name == "bpe":
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality_rules":
            judged = by_id(quality_rules.quality_rules(read(spark, SF, "documents")))
            assert after == {i: r["clean_text"] for i, r in judged.items() if r["kept"]}
            assert all(not base_counts(before[i])[-1] for i in after)
            assert all(set(after[i].split("\n")) <= set(before[i].split("\n")) for i in after)
        elif name == "line_dedup":
            kept = {i: "\n".join(x) for i, x, _ in dedup_lines(list(before.items()))}
            assert after == {i: t for i, t in kept.items() if t.strip() or t == before[i]}
        elif name == "simhash":
            # Five words and a similarity of 0.8, as the task sets for stages; the three bits are op5's contract.
            rows = sorted(before.items())
            assert after == {rows[a][0]: rows[a][1] for a in brute_groups(rows)}
        else:
            items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
            hit = {i: n for i, _, n, _ in brute_contamination(before.items(), items)}
            assert all(after[i] == before[i] for i in after if not hit[i])
            assert not any(n for _, _, n, _ in brute_contamination(after.items(), items))
            assert all(hit[i] for i in set(before) - set(after))
        before = after
    assert {r["doc_id"]: r["decoded_sha256"] for r in docs.collect()} == {i: sha(t) for i, t in before.items()}


# --- names and repeated rows

EXTRA = "row body _text _id _digest _n _key _keys _own _words _ranks _version _runs digest stored id version at h fp node spans kept_lines document label".split()
OPERATORS = {
    "decontaminate": lambda d, b, path: decontaminate.decontaminate(d, b),
    "contamination": lambda d, b, path: decontaminate.contamination(d, b),
    "url_filter": lambda d, b, path: url_filter.url_filter(d, q.URL_RULES, url="text"),
    "html_extract": lambda d, b, path: html_extract.extract_main_text(d, html_column="body"),
    "token_counts": lambda d, b, path: token_counts.token_counts(d, public_tokenizers.path("byte_bpe_50k.json"), cache=path),
    "quality_model": lambda d, b, path: quality_model.score(d, quality_model.fit(np.zeros((0, len(quality_model.FEATURES))), np.zeros(0))),
    "line_dedup": lambda d, b, path: line_dedup.line_dedup(d),
    "quality_rules": lambda d, b, path: quality_rules.quality_rules(d),
    "one_per_group": lambda d, b, path: shingle_groups.one_per_group(d),
}
RESULT = {"contamination": {"spans"}, "html_extract": {"body"}, "line_dedup": {"kept_lines"}}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_and_repeated_rows(spark, name, tmp_path):
    texts = [None, "", "one two three four five six seven eight nine ten eleven.", "one two three four five six seven eight nine ten eleven.", "Alone here."]
    df = spark.createDataFrame([(i // 2, t, *[f"{c}{i}" for c in EXTRA]) for i, t in enumerate(texts)], "doc_id int, text string, " + ", ".join(f"{c} string" for c in EXTRA))
    bench = spark.createDataFrame([(1, "three four five"), (None, "six seven")], "item_id int, text string")
    out = OPERATORS[name](df, bench, f"file://{tmp_path}/cache").collect()
    kept = [c for c in EXTRA if c not in RESULT.get(name, ())]
    rows = sorted(tuple(r[c] for c in kept) for r in out)
    given = sorted(tuple(f"{c}{i}" for c in kept) for i in range(len(texts)))
    if name == "one_per_group":
        assert len(rows) == 3 and set(rows) < set(given)
    else:
        assert rows == given


@pytest.mark.parametrize("stage", ["quality_rules", "line_dedup", "simhash", "decontaminate", "bpe"])
def test_stages_on_odd_rows(spark, odd, stage):
    import corpus_pipeline

    run = dict(corpus_pipeline.STAGES)[stage]
    docs = odd.withColumnsRenamed({"spans": "row"})
    out = run(spark, docs, SF)
    assert run(spark, docs.limit(0), SF).count() == 0
    if stage == "bpe":
        assert out.count() == docs.count()
    else:
        assert out.columns == docs.columns
        assert all(tuple(r[c] for c in docs.columns[2:]) == ("x", "y", 1, "h", "s", 2) for r in out.collect())


def test_cache_with_digests_twice(spark, tmp_path):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    df = spark.createDataFrame([(1, "some text"), (2, "some text")], "doc_id int, text string")
    first = sorted(map(tuple, token_counts.token_counts(df, path, cache=cache).collect()))
    folder = f"{cache}/{token_counts.tokenizer_digest(path)}"
    spark.read.parquet(folder).write.mode("append").parquet(folder)
    assert sorted(map(tuple, token_counts.token_counts(df, path, cache=cache).collect())) == first


def test_token_counts_query(spark, table):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = by_id(q.op4_token_counts(spark, SF))
    assert len(found) == len(table)
    for i, text in table.items():
        n = len(lib.encode(text or "", add_special_tokens=False))
        assert (found[i]["n_bytes"], found[i]["n_tokens"], found[i]["over_limit"]) == (len((text or "").encode()), n, n > 1024)


def test_quality_model_by_plain_sums():
    rng = np.random.default_rng(3)
    x = rng.random((300, len(quality_model.FEATURES)))
    y = (x[:, 0] + x[:, 3] * x[:, 5] + 0.2 * rng.random(300) > 0.8).astype(float)
    model = quality_model.fit(x, y, rounds=10, pair_rounds=5)
    assert any(t.any() for _, _, t in model.pairs)
    bin_of = lambda edges, v: sum(e <= v for e in edges)
    for row, got in zip(x, model.score(x), strict=True):
        total = model.base + sum(t[bin_of(e, v)] for t, e, v in zip(model.tables, model.edges, row, strict=True))
        total += sum(t[bin_of(model.pair_edges[a], row[a]), bin_of(model.pair_edges[b], row[b])] for a, b, t in model.pairs)
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-9


# Pages written by hand, apart from the layouts that the model is trained on: html, and its main text.
PAGES = [
    ("<html><body><div id=top><a href=/>News</a> <a href=/s>Sport</a></div><article><h1>Rain returns</h1><p>It will rain in the north today.</p><p>The south stays dry until Friday.</p></article><div class=footer>Copyright 2020 The Paper</div></body></html>", ["Rain returns", "It will rain in the north today.", "The south stays dry until Friday."]),
    ("<body><header><nav><a href=a>Home</a><a href=b>Blog</a></nav></header><main><h2>On bread</h2><p>Bread needs time, flour and water.</p><ul><li>Mix it well.</li><li>Let it rest for a night.</li></ul></main><aside class=sidebar><h4>Popular</h4><a href=c>On soup</a></aside><footer>Contact us</footer></body>", ["On bread", "Bread needs time, flour and water.", "Mix it well.", "Let it rest for a night."]),
    ("<body><div class=cookie-banner>We use cookies. <button>OK</button></div><div class=content><p>The committee met on Tuesday &amp; agreed on the plan.</p><blockquote>We are pleased, said the chair.</blockquote></div><div class=comments><p>Nice plan!</p><p>I disagree with it all.</p></div></body>", ["The committee met on Tuesday & agreed on the plan.", "We are pleased, said the chair."]),
    ("<body><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><article><p>Short.</p><p>A longer paragraph follows here, with <b>bold</b> words and <a href=x>a link</a> inside.</p><div class=ad>Buy now, cheap phones</div><p>And the end of it.</p></article><form class=search><label>Search</label><input></form></body>", ["Short.", "A longer paragraph follows here, with bold words and a link inside.", "And the end of it."]),
]


def test_html_on_pages_written_apart():
    crf = html_extract.trained(400, 0)
    right = found = wanted = 0
    for page, main in PAGES:
        got = html_extract.extract(page, crf).split("\n")
        right += len(set(got) & set(main))
        found += len(got)
        wanted += len(main)
    assert right / found >= 0.9 and right / wanted >= 0.9


def test_html_deep_pages():
    import time

    page = "<div class=a><b>" * 20_000 + "text"
    began = time.time()
    assert [b.text for b in html_extract.leaf_blocks(page)] == ["text"]
    assert [b.text for b in html_extract.leaf_blocks("<div><i>word</div></span>" * 5_000)] == ["word"] * 5_000
    assert time.time() - began < 20


def test_long_host(spark):
    df = spark.createDataFrame([(1, "http://" + "a." * 20_000 + "example.net/en/x")], "page_id int, url string")
    assert url_filter.url_filter(df, q.URL_RULES).first()["rule"] == "example.net/en/"


@pytest.mark.parametrize("hot", [4])
def test_hot_buckets_to_the_last(spark, hot):
    # Fingerprints that agree on so many bits that every level stays hot.
    fps = [k << 20 for k in range(40)] + [(k << 20) | 1 << 63 for k in range(20)]
    df = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps], "fp long")
    pairs = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in simhash.near_links(df, hot=hot).collect()]
    at = {f: i for i, f in enumerate(fps)}
    got = simhash.forest(len(fps), np.array([at[u] for u, _ in pairs]), np.array([at[v] for _, v in pairs]))
    far = np.bitwise_count(np.array(fps, np.uint64)[:, None] ^ np.array(fps, np.uint64)[None, :])
    assert (got == simhash.forest(len(fps), *np.nonzero(far <= 3))).all()


# --- SQL


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, expected = q.QUERIES[name](spark, SF), con.sql(q.ORACLE_SQL[name])
    rows = lambda names, found: sorted((tuple(r[i] for i in sorted(range(len(names)), key=names.__getitem__)) for r in found), key=repr)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(expected.columns, expected.fetchall())
