"""Encoding, packing, extraction, toxicity and language against plain code."""

import html as references
import random
import re
import time
import tracemalloc
import zlib
from array import array
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from biblioweave.llm import bpe, html, language, packing, toxicity

FOLDER = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as f:
        return bpe.read_ranks(f.read())


@pytest.mark.parametrize("leaf_chars,leaf_bytes", [(2048, 3), (1, 1), (3, 2), (7, 5)])
def test_bpe_tree_gives_the_library_s_ids(ranks, monkeypatch, leaf_chars, leaf_bytes):
    monkeypatch.setattr(bpe, "LEAF_CHARS", leaf_chars)
    monkeypatch.setattr(bpe, "LEAF_BYTES", leaf_bytes)
    own = bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(leaf_chars)
    parts = ["a", "b", "'s", "'l", "l", "'", " ", "  ", "\n", "1", "½", "é", "中", "!", "\x1c", "\x85", "\xa0", "Ⅷ", "_", "😀", "the", "ing"]
    some = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(400)]
    for text in [*some, "ab" * 3000, "a" * 2000, " " * 999 + "x", "x" + "\n " * 500]:
        ids = own.encode(text)
        assert ids == array("I", library.encode_ordinary(text)).tobytes()
        assert own.decode(ids) == text.encode()


def test_bpe_of_messy_rows(messy, nothing):
    rows = bpe.encode_texts(messy, RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == messy.count()
    assert all(bytes(r.decoded).decode() == (r.row.text or "") for r in rows)
    assert bpe.encode_texts(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def check_packing(rows, docs, pieces, length=packing.SEQUENCE_TOKENS):
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    expected = Counter()
    for r in docs:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, packing.END_ID]
        expected[r.doc_id, tuple(ids)] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in rows:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p.length
        by_doc[p.doc_id, p.doc_tokens].append((p.start, ids))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for (doc, n), found in by_doc.items():
        copies = sum(c for (d, ids), c in expected.items() if d == doc and len(ids) == n)
        assert sum(len(ids) for _, ids in found) == n * copies
        for start, ids in found:
            assert any(d == doc and list(whole[start : start + len(ids)]) == ids for d, whole in expected)
    assert sum(len(i) for _, i in expected.elements()) == sum(p.length for p in rows)
    for sequence, found in by_sequence.items():
        at = 0
        for offset, size in sorted(found):
            assert offset == at
            at += size
        assert at == length or sequence == max(by_sequence)


def test_packing_places_every_token_once(messy, nothing):
    rows = packing.pack(messy, WORDS, length=256).collect()
    check_packing(rows, messy.collect(), rows, 256)
    assert packing.pack(nothing, WORDS).count() == 0


def test_packing_follows_the_weights(spark):
    docs = spark.createDataFrame([(i, "word " * 50, "a" if i % 4 else "b") for i in range(40)], "doc_id long, text string, source string")
    rows = packing.pack(docs, WORDS, weights={"a": 1, "b": 1}, length=64).collect()
    check_packing(rows, docs.collect(), rows, 64)
    of_b = defaultdict(int)
    for p in rows:
        of_b[p.sequence_id] += p.length * (p.doc_id % 4 == 0)
    assert all(31 <= of_b[k] <= 33 for k in range(12))  # until b is empty


def test_schedule_is_exact_for_any_sizes():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.randint(40, 900) for _ in range(rng.randint(1, 6))]
        weights = [Fraction(rng.randint(1, 4)) for _ in sizes]
        schedule = packing.Schedule(sizes, weights, 128)
        placed = sorted(
            (window * 128 + offset, size)
            for queue, n in enumerate(sizes)
            for start in range(0, n, 37)
            for _, size, window, offset in schedule.pieces(queue, start, min(37, n - start))
        )
        at = 0
        for place, size in placed:
            assert place == at
            at += size
        assert at == sum(sizes)


PAGE = """<html><head><title>x</title><script>var a = "<p>no</p>";</script></head><body><header class="site-header"><h1>Site</h1>
<a href=a>Home</a></header><div id="cookie-notice">We use cookies to make this site better for you and for us too.</div>
<div class="wrap"><main><article><header><h1>Real &amp; title</h1></header><p>First   para &#233; with <a href="x">link</a> words.
<p>Second<br>para &lt;b&gt;</p><ul><li>one<li>two</ul><form><label>Your name</label><input></form><aside class=related><p>Related things
</p></aside></article></main><div class="comments"><p>I think this is a comment with long text in it and so on</p></div></div>
<footer>c 2020</footer></body></html>"""


def test_main_text_of_a_page():
    tree = html.learn_tree()
    assert html.main_text(PAGE, tree) == "Real & title\nFirst para é with link words.\nSecond para <b>\none\ntwo"
    bare = "<p>A plain page without containers but with many words in its only long paragraph.</p><p>Short.</p>"
    bare += "<p>Another paragraph of the text that again has quite a few words in it.</p><ul><li><a>x</a><li><a>y</a></ul>"
    assert html.main_text(bare, tree).split("\n")[1] == "Short." and html.main_text(bare, tree).count("\n") == 2
    for broken in ("", "<", "<p", "<!-- open", "<script>x", '<a href="x', "</div></p>", "<table><tr><td>"):
        assert "<" not in html.main_text(broken, tree).removeprefix("<")
    assert html.learn_tree().decide(html.LABELLED[:, :-1]).mean() == pytest.approx(html.LABELLED[:, -1].mean(), abs=0.05)


LONG = "Sixty words of text are here so that nobody takes this for a menu or a note, " * 4
ARTICLE = f"<h1>On rivers</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p>"
WANTED = f"On rivers\n{LONG.strip()}\nShort.\n{LONG.strip()}"


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="layout has-sidebar"><article>{ARTICLE}</article></div>',
        f'<div class="page-header-fixed"><nav><a href="/">Home</a></nav><article>{ARTICLE}</article><footer>c 2020</footer></div>',
        f'<form id="form1" action="/"><div class="sidebar">Note of the day</div><article>{ARTICLE}</article></form>',
        f'<form class="search"><div>{ARTICLE}</div></form>',
        f'<main><div class="search-results">{ARTICLE}</div></main>',
        f'<article><div class="form-of-life"><section class="related-work">{ARTICLE}</section></div></article>',
        f'<article>{ARTICLE}</article><div class="related"><article><h2>Other</h2><p>{LONG}</p></article></div>',
        f'<article>{ARTICLE}</article><div id="comments"><article class="comment-body"><p>{LONG * 9}</p></article></div>',
        f'<article>{ARTICLE}<ul><li><a href="/1">One more</a></li><li><a href="/2">Two more</a></li><li><a href="/3">Three more</a></li></ul></article>',
        f'<div class="site-header">Site</div><article><header class="header">{ARTICLE}</header></article><div class="cookie-notice">We use cookies</div>',
        f'<article>{ARTICLE}</article><aside><article><p>{LONG * 9}</p></article></aside>',
    ],
)
def test_main_text_within_wrappers(page):
    assert html.main_text(f"<html><body>{page}</body></html>", html.learn_tree()) == WANTED


def test_links_within_the_text_stay():
    page = f'<article><p>{LONG}</p><p><a href="/s">The source</a></p><p>{LONG}</p></article>'
    assert html.main_text(page, html.learn_tree()) == f"{LONG.strip()}\nThe source\n{LONG.strip()}"


@pytest.mark.parametrize("broken", ["<div></ul>", "<select>", "<noscript>x", '<a "x>" ', "<a '", "<", "<!-", "<p class=\"a", "<li><a>", "</div>", "&amp", "<a <b"])
def test_broken_markup_takes_time_in_proportion(broken):
    tree = html.learn_tree()
    for extra in ("", '"', ">"):
        page = broken * (1_000_000 // len(broken)) + extra
        start = time.monotonic()
        html.main_text(page, tree)
        assert time.monotonic() - start < 10


def test_main_text_is_the_article_of_every_page(spark):
    """The pages of the smallest table hold their text in one article without wrappers."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html.extract(pages, keep=["html"]).collect():
        inner = re.search(r"<article>(.*?)</article>", r.row.html, re.S)[1]
        parts = re.split(r"</?(?:h1|p)>", inner)
        plain = [" ".join(references.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in parts]
        assert r.main_text == "\n".join(x for x in plain if x)


def test_main_text_of_rows(spark):
    pages = spark.createDataFrame([(1, None, "u"), (2, "", "u"), (3, PAGE, None), (3, PAGE, None)], "page_id long, html string, row string")
    found = [r.main_text for r in html.extract(pages).orderBy("row.page_id").collect()]
    assert found[:2] == ["", ""] and found[2] == found[3] != ""
    assert html.extract(pages.limit(0)).count() == 0


def numeric_gradient(network, words, begin, count, marks, name, at, step=1e-4):
    def loss():
        z = network.logits(network.inputs(words).astype(np.float64), begin, count)
        return np.mean(np.log1p(np.exp(-z * (2 * marks - 1))))

    was = network.p[name][at]
    network.p[name][at] = was + step
    up = loss()
    network.p[name][at] = was - step
    down = loss()
    network.p[name][at] = was
    return (up - down) / (2 * step)


def test_toxicity_learns(spark, messy, nothing):
    rng = random.Random(5)
    common, bad = [f"w{i}" for i in range(60)], ["vilest", "rotten"]
    marks = [i % 3 == 0 for i in range(240)]
    docs = [" ".join(rng.choices(common, k=rng.randint(1, 90)) + ([rng.choice(bad)] if m else [])) for m in marks]
    docs = [" ".join(rng.sample(d.split(), len(d.split()))) for d in docs]
    network = toxicity.train(docs[:180], [int(m) for m in marks[:180]], toxicity.Sample(epochs=4))
    hits = (network.scores(docs[180:]) >= 0.5) == np.array(marks[180:])
    assert hits.mean() > 0.9
    words = toxicity.Words(docs[:8])
    begin, count = words.first[:-1], np.minimum(np.diff(words.first), toxicity.WINDOW)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    some = np.array(marks[:8], np.float32)
    for name, grad in network.gradients(words, begin, count, some).items():
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        assert grad[at] == pytest.approx(numeric_gradient(network, words, begin, count, some, name, at), rel=0.05, abs=1e-4)
    found = toxicity.score(messy, network).collect()
    assert len(found) == messy.count() and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.row.text in (None, "", " \t\n ")}) == 1
    assert toxicity.score(nothing, network).count() == 0
    assert toxicity.train(["a"], [1]) is None
    assert {r.score for r in toxicity.score(messy, None).collect()} == {0.0}


def test_toxicity_training_holds_few_characters_at_a_time(monkeypatch):
    rng = np.random.default_rng(1)
    names = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(5000)])
    docs = [" ".join(rng.choice(names, 170)) + (" vile" if i % 2 else "") for i in range(2000)]
    marks = [i % 2 for i in range(2000)]
    tracemalloc.start()
    network = toxicity.train(docs, marks, toxicity.Sample(epochs=0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6  # 2.4 million characters: over 250 MB when all are numbers at once
    monkeypatch.setattr(toxicity, "CHARS_PER_STEP", 50_000_000)
    whole = toxicity.train(docs, marks, toxicity.Sample(epochs=0))
    assert all(np.array_equal(network.p[k], whole.p[k]) for k in whole.p) and np.isclose(network.shift, whole.shift)


def test_toxicity_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(None, "x"), (3, "text 3")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    texts, marks = toxicity.labelled_sample(docs, labels, F.col("doc_id") != 1, toxicity.Sample(toxic=4, clean=3))
    assert len(texts) <= 7 and sum(marks) <= 4 and "text 1" not in texts


def plain_language(learn, docs):
    def grams(text):
        out, word = Counter(), ""
        for c in text.lower() + " ":
            if c.isalpha():
                word += c
            elif word:
                padded = f" {word} "
                out.update((0, c) for c in word)
                out.update((1, padded[i : i + 2]) for i in range(len(padded) - 1))
                out.update((2, padded[i : i + 3]) for i in range(len(padded) - 2))
                word = ""
        return out

    def code(g):
        value = 0
        for c in g[1]:
            value = (value << 11) | (0 if c == " " else ord(c) if ord(c) < 1024 else 1024 + ord(c) % 1024)
        return value | (g[0] << 33)

    def places(counts):
        return {g: i for i, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[: language.PROFILE_SIZE])}

    sums = defaultdict(Counter)
    for text, lang in learn:
        sums[lang].update(grams(text))
    profiles = {lang: places(c) for lang, c in sums.items()}
    out = []
    for text in docs:
        own = places(grams(text))
        far = {
            lang: sum(abs(p - i) if (p := profile.get(g)) is not None else language.PROFILE_SIZE for g, i in own.items())
            for lang, profile in profiles.items()
        }
        out.append(min(sorted(far), key=far.get) if own else language.UNDETERMINED)
    return out


def test_language_against_plain_code(spark, messy, nothing):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    found = {r.row.doc_id: r.lang_pred for r in language.identify(docs, fold != 2, keep=["doc_id"]).collect()}
    rows = docs.collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    learn = [(r.text, r.lang) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    assert plain_language(learn, [r.text for r in rows]) == [found[r.doc_id] for r in rows]
    assert np.mean([found[r.doc_id] == r.lang for r in held]) > 0.95
    odd = language.identify(messy, F.lit(True)).collect()
    assert len(odd) == messy.count()
    assert {r.lang_pred for r in odd if not any(c.isalpha() for c in r.row.text or "")} == {"und"}
    assert all(0 <= r.score <= 1 for r in odd)
    assert language.identify(nothing, F.lit(True)).count() == 0
    assert {r.lang_pred for r in language.identify(messy, F.lit(False)).collect()} == {"und"}
    assert language.keep_identified(messy).columns == messy.columns


def test_words_of_like_hashes_keep_their_own_vectors():
    high = np.uint64(77 << 48)
    vocabulary = np.array([high + np.uint64(9), high + np.uint64(3), np.uint64(5)], np.uint64)
    network = toxicity.Network(vocabulary, np.zeros(3, np.float32), np.zeros(toxicity.GRAMS, np.float32))
    assert network.word_ids(np.append(vocabulary, high)).tolist() == [1, 2, 3, 0]
    none = toxicity.Network(vocabulary[:0], np.zeros(0, np.float32), np.zeros(toxicity.GRAMS, np.float32))
    assert none.word_ids(vocabulary).tolist() == [0, 0, 0]


def test_every_half_window_of_words_lies_in_one_window():
    half = toxicity.WINDOW // 2
    for n in (40, 100, 331):
        _, begin, count = toxicity.Words([" ".join(["word"] * n)]).windows()
        assert all(any(b <= at and at + half <= b + c for b, c in zip(begin, count)) for at in range(n - half + 1))


def test_language_steps_take_bounded_memory():
    import tracemalloc

    import pyarrow as pa
    from biblioweave.llm import common, language

    docs = ["the words of a text and some more of them " * 120] * 600 + ["lang " * 100_000, None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(docs)), pa.array(docs, pa.string())], ["lang", "text"])
    parts = list(common.sized_steps([batch], 1, 300_000))
    assert [x for p in parts for x in p.column(1).to_pylist()] == docs
    language._letter_codes()
    tracemalloc.start()
    counted = {r["gram"]: r["n"] for b in language._count_partition([batch]) for r in b.to_pylist()}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    grams, n = language._counted(language.grams([d or "" for d in docs])[1])
    assert counted == dict(zip(grams.tolist(), n.tolist()))
    assert peak < 100e6


def test_steps_are_cut_by_rows_and_by_bytes():
    import pyarrow as pa

    from biblioweave.llm.common import sized_steps

    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10] * 300 + ["y" * 900, None] * 3)], ["text"])
    found = list(sized_steps([batch], 0, 1000, 128))
    assert max(b.num_rows for b in found) <= 128
    assert pa.concat_arrays([b.column(0) for b in found]).equals(batch.column(0))
    assert max(sum(len(x or "") for x in b.column(0).to_pylist()) for b in found) <= 1900


def test_pipeline_stages_ask_for_small_batches(spark):
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for _, stage in corpus_pipeline.STAGES[1:3]:
            spark.conf.set(key, "10000")
            stage(spark, spark.createDataFrame([], "doc_id long, text string, lang string, source string"), "")
            assert int(spark.conf.get(key)) <= 1000
    finally:
        spark.conf.set(key, before)
