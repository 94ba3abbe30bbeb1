"""Fingerprints, personal data, quality rules, near-duplicates and language model against plain code."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from biblioweave.llm import fingerprint, lm, neardup, privacy, quality

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


# fingerprints


def plain_fingerprint(text):
    tokens = re.findall(r"[^\x20\x09-\x0D]{1,16}", text)
    h = [int(hashlib.md5(t.encode()).hexdigest()[:7], 16) % fingerprint.PRIME for t in tokens]
    if len(h) < fingerprint.GRAM_TOKENS:
        return None
    grams = []
    for i in range(len(h) - fingerprint.GRAM_TOKENS + 1):
        value = 0
        for x in h[i : i + fingerprint.GRAM_TOKENS]:
            value = (value * fingerprint.MULTIPLIER + x) % fingerprint.PRIME
        grams.append(value)
    chosen = []
    for i in range(max(1, len(grams) - fingerprint.WINDOW_GRAMS + 1)):
        window = grams[i : i + fingerprint.WINDOW_GRAMS]
        at = max(j for j in range(len(window)) if window[j] == min(window))
        if (window[at], i + at) not in chosen[-1:]:
            chosen.append((window[at], i + at))
    return chosen


def test_fingerprints_against_plain_code(documents):
    rows = sorted(documents.collect(), key=lambda r: -r.doc_id)
    found = {r.row.doc_id: r for r in fingerprint.compare_edited(documents).collect()}
    text = lambda chosen: ",".join(f"{a}:{b}" for a, b in chosen)
    for i, r in enumerate(rows):
        third = len(r.text) // 3
        edited = r.text[: len(r.text) - third] + rows[(i + 1) % len(rows)].text[:third]
        got, own, other = found[r.doc_id], plain_fingerprint(r.text), plain_fingerprint(edited)
        assert got.edited_text == edited and got.n_chars == len(r.text)
        if own and other:
            assert (got.fingerprint, got.edited_fingerprint) == (text(own), text(other))
            a, b = {h for h, _ in own}, {h for h, _ in other}
            assert got.near_edited == pytest.approx(len(a & b) / len(a | b))
    assert np.mean([r.near_edited > r.near_next for r in found.values()]) > 0.9


def test_shared_passages_share_a_hash():
    rng = random.Random(4)
    run = [f"p{i}" for i in range(fingerprint.GRAM_TOKENS + fingerprint.WINDOW_GRAMS - 1)]
    for _ in range(50):
        texts = [" ".join(rng.choices("abcdefg", k=9) + run + rng.choices("hijklmn", k=9)) for _ in range(2)]
        a, b = ({h for h, _ in plain_fingerprint(t)} for t in texts)
        assert a & b


def test_fingerprints_of_messy_rows(messy, nothing):
    rows = fingerprint.compare_edited(messy).collect()
    assert len(rows) == messy.count()
    by_text = defaultdict(set)
    for r in rows:
        by_text[r.row.text or ""].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in by_text.values()) and by_text[""] == {""}
    assert fingerprint.compare_edited(nothing).count() == 0


# personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if passes(k, m[0])]


def test_base_spans_against_plain_code(spark, documents):
    rng = random.Random(9)
    parts = ["a", "b.c", "@", "x.de", "_", "+1", "12", " ", "-", ".", "255", "300", "4111 1111 1111 1111", "(", ")", "é", "😀", "0004", "\n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(600)] + ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "9" * 5000, "a" * 50_000 + "@"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").union(documents.select("text"))
    for r in privacy.with_base_spans(rows).collect():
        assert [(s.kind, s.start, s.end) for s in r["_base"]] == plain_spans(r["_text"])


def test_terms_that_disclose_an_entity(spark):
    words = "one two three four five six".split()
    rows = [(i, f"hello Zanzibar the {w} write bob.0@mail.example.com now quxly please the and") for i, w in enumerate(words)]
    rows += [(100 + i, f"hello the please and now some {w} other words here write") for i, w in enumerate(["red", "blue", "green"] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in privacy.find_personal_data(docs).collect()}
    terms = {rows[0][1][s.start : s.end] for s in found[0]["_extra"]}
    assert {"Zanzibar", "quxly"} <= terms and not terms & {"the", "please", "and", "one"}
    assert not found[100]["_extra"]
    clean = {r.doc_id: r.text for r in privacy.sanitise(docs).collect()}
    assert "Zanzibar" not in clean[0] and "[EMAIL]" in clean[0] and "write" in clean[100]


def plain_extra(texts, least=0.5, most=2**-0.25, chance=0.01):
    """Places of the terms to change in each text, counted in plain code."""
    term = regex.compile(r"\p{L}[\p{L}'-]*+")
    terms = [set(term.findall(re.sub(BASE["email"], " ", t).lower())) for t in texts]
    spans = [plain_spans(t) for t in texts]
    entities = [{(k, t[a:b]) for k, a, b in s} for t, s in zip(texts, spans)]
    n, with_term, with_entity, both = len(texts), Counter(), Counter(), Counter()
    for ts, es in zip(terms, entities):
        with_term.update(ts)
        with_entity.update(es)
        both.update((e, t) for e in es for t in ts)

    def revealed(e, t):
        p, q = with_entity[e] / n, both[e, t] / with_term[t]
        if q <= p:
            return 0
        kl = q * math.log(q / p) + (0 if q == 1 else (1 - q) * math.log((1 - q) / (1 - p)))
        return (both[e, t] + p) / (with_term[t] + 1) if math.exp(-with_term[t] * kl) <= chance else 0

    found = []
    for text, ts, es, base in zip(texts, terms, entities, spans):
        best = {t: max((revealed(e, t) for e in es), default=0) for t in ts}
        marks = [(m.start(), m.end(), best.get(m[0].lower(), 0)) for m in term.finditer(text)] if es else []
        free = [(a, b, p) for a, b, p in marks if p >= least and not any(c < b and a < d for _, c, d in base)]
        found.append(sorted(("removed" if p >= most else "term", a, b) for a, b, p in free))
    return found


def test_disclosing_terms_against_plain_code(spark, documents):
    texts = [r.text or "" for r in documents.select("text").collect()]
    texts += [f"Kanzler of {w} wrote to bob.1@x.example.com and bob.1@x.example.com on the Kanzler, {i % 3}" for i, w in enumerate(["alpha"] * 9)]
    texts += ["Kanzler alone", "", "1.2.3.4 unmet words 1.2.3.4 unmet", "a@b.cd 1.2.3.4 shared"] + ["copied c@d.ef zweimal"] * 2
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r["_extra"]] for r in privacy.find_personal_data(rows).collect()}
    wanted = plain_extra(texts)
    assert [found[i] for i in range(len(texts))] == wanted
    kinds = Counter(kind for x in wanted for kind, _, _ in x)
    assert kinds["term"] > 20 and kinds["removed"] >= 18


def test_sanitising_messy_rows(messy, nothing):
    clean = privacy.sanitise(messy)
    assert clean.columns == messy.columns and clean.count() == messy.count()
    assert privacy.sanitise(nothing).count() == 0


# quality rules


def plain_counts(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def test_base_counts_against_plain_code(messy, documents):
    rows = messy.select("text").union(documents.select("text"))
    for r in quality.base_counts(rows).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == plain_counts(r.text or "")


def test_boilerplate_lines_are_removed(spark):
    body = lambda i: "\n".join(" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{c}{chr(97 + k)}" for c in "abcdefghij") for k in range(3))
    rows = [(i, f"{body(i)}\nShare this 2024 page!", "h") for i in range(60)]
    rows += [(100 + i, body(70), "h") for i in range(60)]  # exact copies
    rows += [(200, "\n".join(["Share this 1999 page!"] * 12 + ["a few words of its own"]), "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert all(found[i].removed_words == 4 and found[i].kept for i in range(60))
    assert all(found[100 + i].removed_words == 0 and found[100 + i].kept for i in range(60))
    assert not found[200].kept
    clean = {r.doc_id: r.text for r in quality.clean_documents(docs).collect()}
    assert set(clean) == {i for i, r in found.items() if r.kept}
    assert clean[0] == body(0)


def test_footers_long_lines_and_pages_of_boilerplate(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    lines = lambda n, of: [" ".join(word() for _ in range(of)) for _ in range(n)]
    footer, passage, common, copied = lines(5, 4), lines(1, 60), lines(5, 21), lines(30, 10)
    rows = [(i, "\n".join(lines(6, 10) + footer), "h") for i in range(60)]
    rows += [(100 + i, "\n".join(lines(10, 10) + passage + lines(1, 10)), "h") for i in range(60)]
    rows += [(200 + i, "\n".join(common + lines(1, 10)), "h") for i in range(120)]
    # copies up to case, digits and marks are one document (two here, with one digit and with two)
    rows += [(400 + i, "\n".join(f"{x.upper() if i % 2 else x} {i}!" for x in copied), "h") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert [found[i].removed_words for i in range(60)] == [20] * 60
    assert [found[100 + i].removed_words for i in range(60)] == [60] * 60
    assert all(found[200 + i].removed_words == 105 and not found[200 + i].kept for i in range(120))
    assert all(found[400 + i].removed_words == 0 and found[400 + i].kept for i in range(60))
    clean = {r.doc_id: r.text for r in quality.clean_documents(docs).collect()}
    assert set(clean) == {i for i, r in found.items() if r.kept}
    assert all(not set(clean[i].split("\n")) & {*footer, *passage} for i in (*range(60), *range(100, 160)))
    assert all(clean[i] == t for i, t, _ in rows[240:])


def test_equal_rows_lose_their_words_once_each(spark):
    rows = [(i, f"own{chr(97 + i)} words of text here\nall have this line", "h") for i in range(25)]
    docs = spark.createDataFrame(rows + rows[:1] * 3, "doc_id long, text string, source string")
    found = quality.quality_rules(docs).collect()
    assert len(found) == 28 and {r.removed_words for r in found} == {4}


def test_quality_of_messy_rows(messy, nothing):
    assert quality.quality_rules(messy).count() == messy.count()
    kept = quality.clean_documents(messy)
    assert kept.columns == messy.columns
    assert quality.quality_rules(nothing).count() == quality.clean_documents(nothing).count() == 0


# near-duplicates


def plain_classes(texts):
    """Classes by comparing all pairs, weights from document frequencies."""
    counts = []
    for t in texts:
        words = WORD.findall(t.lower())
        n = neardup.SHINGLE_WORDS
        counts.append(Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else Counter([tuple(words)] if words else []))
    df = Counter(s for c in counts for s in c)
    weight = lambda s: 1 + math.log(len(texts) / df[s]) / math.log(len(texts))
    vectors = [{s: k * weight(s) for s, k in c.items()} for c in counts]
    group = list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    holders = defaultdict(list)
    for i, v in enumerate(vectors):
        for s in v or {(): 0}:
            holders[s].append(i)
    for a, b in {(i, j) for h in holders.values() for i in h for j in h if i < j}:
        least = sum(min(w, vectors[b].get(s, 0)) for s, w in vectors[a].items())
        whole = sum(vectors[a].values()) + sum(vectors[b].values()) - least
        if not whole or least / whole >= neardup.THRESHOLD:
            group[root(a)] = root(b)
    return [root(i) for i in range(len(texts))]


def same_partition(one, other):
    return len(set(zip(one, other))) == len(set(one)) == len(set(other))


def test_near_duplicates_against_all_pairs(documents):
    rows = documents.collect()
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(documents).collect()}
    assert same_partition(plain_classes([r.text for r in rows]), [found[r.doc_id] for r in rows])


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(400)] = f"x{i}"
        texts.append(" ".join(words))
    texts += [" ".join(f"y{i}-{k}" for k in range(60)) for i in range(300)] + [texts[0]] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert same_partition(plain_classes(texts), [found[i] for i in range(len(texts))])
    assert {found[i] for i in range(150)} == {0}
    assert neardup.keep_one(docs).count() == 301


def test_rounds_with_new_centres_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(neardup, "PAIRS_PER_TEXT", 0.02)
    rng = random.Random(2)
    texts = []
    for _ in range(6):  # chains: each text is near the one before it only
        words = [f"c{rng.random()}" for _ in range(60)]
        for i in range(6):
            texts.append(" ".join(words))
            words = [*words[2:], f"n{rng.random()}", f"n{rng.random()}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert same_partition(plain_classes(texts), [found[i] for i in range(len(texts))])


def mixed_copies(n, seed):
    """Copies of one text with 0 to 6 words changed, half of them at places of a common variant."""
    rng, texts = random.Random(seed), []
    for i in range(n):
        words = [f"w{k}" for k in range(140)]
        if i % 2:
            words[20:23] = ["v1", "v2", "v3"]
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(140)] = f"x{rng.randrange(40)}"
        if i % 10 == 0:
            del words[rng.randrange(100, 140) :]
        texts.append(" ".join(words))
    return texts


def watch(monkeypatch):
    """Pairs compared in each level."""
    levels, verify = [], neardup._verify
    monkeypatch.setattr(neardup, "_verify", lambda pairs, *rest: [out := verify(pairs, *rest), levels.append(out.count())][0])
    return levels


@pytest.mark.parametrize("limit", [2_000, 40])
def test_no_pair_of_a_bucket_is_lost(spark, monkeypatch, limit):
    texts = mixed_copies(260, 4) + [" ".join(f"y{i}-{k}" for k in range(60)) for i in range(900)]
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 3)
    monkeypatch.setattr(neardup, "FAR_LIMIT", limit)
    monkeypatch.setattr(neardup, "PAIRS_PER_TEXT", 0.2)
    levels = watch(monkeypatch)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert same_partition(plain_classes(texts), [found[i] for i in range(len(texts))])
    assert len(levels) > 1


def test_work_on_a_group_of_near_copies_grows_with_the_texts(spark, monkeypatch):
    levels = watch(monkeypatch)
    texts = mixed_copies(2_000, 5) + [" ".join(f"y{i}-{k}" for k in range(30)) for i in range(4_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert neardup.near_duplicates(docs).count() == len(texts)
    assert sum(levels) <= 2 * neardup.BANDS * 2_000
    assert len(levels) <= 11  # the logarithm of the texts


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_contracted_links_give_connected_groups(spark, pairs):
    group = list(range(26))
    for a, b in pairs:
        group = [group[b] if g == group[a] else g for g in group]
    edges = neardup._relabelled(spark.createDataFrame(pairs, "a long, b long"), None)
    found = neardup.contract(edges, 2)
    labels = {} if found is None else {r.node: r.label for r in found.collect()}
    assert same_partition(group, [labels.get(i, i) for i in range(26)])


def test_counters_count_documents(spark, monkeypatch):
    texts = ["a b c d e f", "a b c d e", "a b c d e f g", None, "x y"] * 40
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    weights = neardup.document_frequencies(docs, "text")
    ids = neardup.shingles(["a b c d e", "b c d e f", "x y", "never seen"])[1]
    wanted = 1 + np.log(200 / np.array([120, 80, 40, 1])) / np.log(200)
    assert np.allclose(np.sort(weights.idf_of(ids)), np.sort(wanted), atol=0.05)


def test_samples_agree_as_often_as_texts_are_similar():
    weights, rng = neardup.Weights(np.zeros(1024, np.int64), 10), random.Random(1)
    sampler = neardup.Sampler(weights)
    words = [f"w{i}" for i in range(300)]
    agree, wanted = [], []
    for _ in range(40):
        cut = rng.randint(5, 60)
        one, other = " ".join(words), " ".join(words[:-cut] + [f"z{rng.random()}" for _ in range(cut)])
        bands, _ = sampler.bands([one, other])
        agree.append((bands[0] == bands[1]).mean())
        wanted.append(neardup.similarity(one, other, weights) ** neardup.BAND_ROWS)
    assert np.mean(agree) == pytest.approx(np.mean(wanted), abs=0.06)


def test_near_duplicates_of_messy_rows(messy, nothing):
    rows = neardup.near_duplicates(messy).collect()
    assert len(rows) == messy.count()
    kept = neardup.keep_one(messy)
    assert kept.columns == messy.columns and kept.count() == len({r.label for r in rows})
    assert neardup.near_duplicates(nothing).count() == neardup.keep_one(nothing).count() == 0


# language model


def plain_base(rows, learn):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = [[*WORD.findall((t or "").translate(low)), None] for t in rows]
    counts = Counter(x for t, used in zip(tokens, learn) if used for x in t)
    total, distinct = sum(counts.values()), len(counts)
    return [(len(t), sum(counts[x] > 0 for x in t), total, sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in t)) for t in tokens]


def test_language_model(documents, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_CHARS", 60_000)  # several blocks and parts
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    found = {r.row.doc_id: r for r in lm.score(documents, fold != 2, fold == 3).collect()}
    rows = documents.collect()
    folds = [zlib.crc32(str(r.doc_id).encode()) % 7 for r in rows]
    for r, (n, known, total, base) in zip(rows, plain_base([r.text for r in rows], [f != 2 for f in folds])):
        got = found[r.doc_id]
        assert (got.n_tokens, got.n_known, got.train_tokens) == (n, known, total)
        assert got.base_score == pytest.approx(base, rel=1e-9) and got.score < 0
    held = [found[r.doc_id] for r, f in zip(rows, folds) if f == 2]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_pair_estimates_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b a b"), (2, "a c"), (3, "a b d")], "doc_id long, text string")
    got = {r.row.doc_id: r.score for r in lm.score(docs, F.col("doc_id") < 3, F.lit(False)).collect()}
    # without tuning documents each estimate weighs a third; an unseen context leaves halves
    tokens, starts = {"a": 3, "b": 2, "c": 1, None: 2}, {"<s>": 2, "a": 3, "b": 2, "c": 1, "d": 0}
    pairs = {("<s>", "a"): 2, ("a", "b"): 2, ("b", "a"): 1, ("b", None): 1, ("a", "c"): 1, ("c", None): 1}
    score = 0.0
    for h, w in (("<s>", "a"), ("a", "b"), ("b", "d"), ("d", None)):
        parts = [tokens.get(w, 0) / 8, 1 / 5] + ([pairs.get((h, w), 0) / starts[h]] if starts[h] else [])
        score += math.log10(sum(parts) / len(parts))
    assert got[3] == pytest.approx(score)


def test_mixture_finds_the_better_estimate():
    near, far = int(lm._level(np.array([0.5]))[0]), int(lm._level(np.array([0.001]))[0])
    weights = lm.mixture([(3, near, far, 100), (5, 0, near, 100)], 1e-6)
    assert weights[3, 0] > 0.95 and weights[5, 1] > 0.95 and weights[0, 0] == 0
    assert np.allclose(weights.sum(axis=1), 1)


def test_language_model_of_messy_rows(messy, nothing):
    rows = lm.score(messy, F.lit(True), F.lit(False)).collect()
    assert len(rows) == messy.count() and all(r.score <= 0 for r in rows)
    none = lm.score(messy, F.lit(False), F.lit(False)).collect()
    assert {r.n_known for r in none} == {0} and {r.score for r in none} == {0.0}
    assert lm.score(nothing, F.lit(True), F.lit(True)).count() == 0


def test_star_rows_that_no_far_text_can_meet_go_early(spark, monkeypatch):
    """A near text whose excess only fits one far text's excess and another's reach has no pair; nor has an element of one text."""
    written = []

    def keep(df, label, files):
        written.append((label, df.count()))
        return df.cache()

    monkeypatch.setattr(neardup, "_written", keep)
    texts = [("near", 0.9, 3.2, [7], [2.2]), ("far1", 0.5, 1.0, [7], [0.1]), ("far2", 0.5, 5.0, [7, 8], [4.0, 4.0])]
    stars = spark.createDataFrame([(1, "c", name) for name, *_ in texts], "star_id long, a string, b string")
    verified = spark.createDataFrame([("c", *t[:2], True, *t[2:]) for t in texts],
                                     "a string, b string, similarity double, star boolean, excess double, elements array<long>, reaches array<double>")
    buckets, pairs = neardup._beyond_centres(stars, verified, 0.8, 1, 64)
    assert written[1] == ("star-elements", 0)
    assert pairs.count() == buckets.count() == 0
    more = verified.union(spark.createDataFrame([("c", "near2", 0.9, True, 2.9, [7], [4.0])], verified.schema))
    stars = stars.union(spark.createDataFrame([(1, "c", "near2")], stars.schema))
    assert [tuple(r) for r in neardup._beyond_centres(stars, more, 0.8, 1, 64)[1].collect()] == [("far2", "near2")]
