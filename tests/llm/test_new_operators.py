"""Exact deduplication, filter interactions and phrases against plain code."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from biblioweave.llm import exact, interactions, phrases, queries, quotient

SPACE = r"[\x20\x09-\x0D]+"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# exact deduplication


def plain_groups(docs):
    """Best (n_chars, id) and size by bare text."""
    groups = defaultdict(list)
    for doc_id, text in docs:
        groups[re.sub(SPACE, "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0))
    return groups


def check_exact(docs, found):
    groups = plain_groups([(d["doc_id"], d["text"]) for d in docs])
    assert len(found) == len(docs)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    kept = Counter()
    for r in found:
        group = by_hash[r["text_sha256"]]
        best = min(group)
        assert r["group_size"] == len(group)
        assert r["keep_id"] == (None if best[1] else best[2])
        kept[r["text_sha256"]] += r["kept"]
    assert kept == dict.fromkeys(by_hash, 1)


def exact_rows(df):
    return rows(
        exact.refine(df, keep=["doc_id"], extra=lambda t: queries.F.sha2(t, 256)).select("row.doc_id", "keep_id", "group_size", "kept", queries.F.col("extra").alias("text_sha256"))
    )


def test_exact_groups_of_awkward_texts(messy):
    check_exact(rows(messy), exact_rows(messy))


def test_exact_prefers_the_longest_original_and_sees_late_differences(spark):
    long = "a" * 5_000
    docs = [(9, "a b c"), (3, "ab c"), (1, "abc"), (2, "a b\tc"), (4, long + "x"), (5, long + "y"), (6, long + " x"), (7, "abd"), (None, "a b c"), (8, None), (10, " \n")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = exact_rows(df)
    check_exact(rows(df), found)
    kept = {r["doc_id"] for r in found if r["kept"]}
    assert kept == {2, 6, 5, 7, 10}


def test_exact_with_one_group_of_a_third_and_a_full_bitmap(spark, monkeypatch):
    monkeypatch.setattr(exact, "MAX_BITS", 1)  # a bitmap of the least size, which is crowded
    docs = [(i, "same text" if i % 3 == 0 else f"text {i // 2}") for i in range(3_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    check_exact(rows(df), exact_rows(df))


def test_exact_of_nothing_and_keep_one(messy, nothing):
    assert exact_rows(nothing) == []
    kept = exact.keep_one(messy)
    assert kept.columns == messy.columns
    assert kept.count() == len(plain_groups([(d["doc_id"], d["text"]) for d in rows(messy)]))


# filter interactions

id_lists = st.lists(st.lists(st.integers(0, 60), unique=True).map(sorted), max_size=5)


@settings(max_examples=200, deadline=None)
@given(id_lists, st.lists(st.integers(0, 60), unique=True).map(sorted))
def test_galloping_merges(lists, ids):
    assert interactions.union(lists) == sorted(set().union(*lists))
    assert interactions.difference(ids, lists) == [x for x in ids if not any(x in other for other in lists)]


def test_gallop_takes_few_steps():
    class Counting(list):
        reads = 0

        def __getitem__(self, k):
            Counting.reads += 1
            return super().__getitem__(k)

    ids = Counting(range(0, 2_000_000, 2))
    assert interactions.gallop(ids, 1_500_001, 0) == 750_001
    assert Counting.reads < 50


def plain_audit(docs, labels):
    first = {}
    for d in docs:
        if d["doc_id"] is not None:
            t = d["text"] or ""
            first[t] = min(first.get(t, d["doc_id"]), d["doc_id"])
    told = defaultdict(lambda: [0, 0])
    for doc_id, quality, toxic in labels:
        if doc_id is not None:
            told[doc_id] = [max(told[doc_id][0], quality or 0), max(told[doc_id][1], toxic or 0)]
    parts = defaultdict(list)
    for d in docs:
        t = d["text"] or ""
        words = [w for w in re.split(SPACE, t) if w]
        fails = set()
        if len(words) < 100:
            fails.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t):
            fails.add("C")
        if re.search(r"[#$%&*|]", t):
            fails.add("D")
        if d["doc_id"] is not None and d["doc_id"] > first[t]:
            fails.add("E")
        good, toxic = told[d["doc_id"]] if d["doc_id"] in told else (0, 0)
        parts[d["lang"] or ""].append((fails, good == 1, toxic == 1))
    out, shapley = {}, Counter()
    for part, members in parts.items():
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                before = set(order[:step])
                removed = [m for m in members if f in m[0] and not m[0] & before]
                shapley[part, f] += len(removed)
                out[part, "".join(order), step + 1] = {
                    "kept": sum(not m[0] & (before | {f}) for m in members),
                    "removed": len(removed),
                    "redundant": sum(f in m[0] and bool(m[0] & before) for m in members),
                    "unique_fails": sum(m[0] == {f} for m in members),
                    "lost_quality": sum(m[1] for m in removed),
                    "lost_toxic": sum(m[2] for m in removed),
                }
    for (part, order, step), values in out.items():
        values["shapley"] = shapley[part, order[step - 1]]
    return out


def check_audit(spark, docs, labels):
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = rows(interactions.audit(docs, told, interactions.text_filters(), "E"))
    seen = {(r.pop("part"), r.pop("filter_order"), r.pop("step")): r for r in found}
    assert seen == plain_audit(rows(docs), labels)


def test_audit_of_awkward_texts(spark, messy):
    check_audit(spark, messy, [(0, 1, 0), (4, 0, 1), (6, 1, 1), (0, None, 1), (None, 1, 1)])


def test_audit_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(interactions, "RANGE_BITS", 4)
    monkeypatch.setattr(interactions, "PARTS_AT_ONCE", 2)
    pick = random.Random(3)
    texts = ["A few words", "word " * 120, "ABC DEF", "x # y", " ".join(f"w{i}" for i in range(130)), None]
    docs = [(i, pick.choice(texts) if i % 3 else f"own {i} " + "w " * (i % 150), pick.choice(["en", "fr", None, "de"])) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    check_audit(spark, df, [(i, i % 2, int(i % 5 == 0)) for i in range(0, 300, 2)])


def test_audit_of_nothing(spark, nothing):
    told = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.audit(nothing, told, interactions.text_filters(), "E").count() == 0


# quotient filters and phrases


@pytest.mark.parametrize("width", [1, 2, 3, 7, 16, 33, 54, 63, 64])
def test_permutation_can_be_undone(width):
    pick = np.random.default_rng(width)
    x = pick.integers(0, 1 << min(width, 63), 3_000, dtype=np.uint64) if width > 10 else np.arange(1 << width, dtype=np.uint64)
    y = quotient.permute(x, width)
    assert (y <= np.uint64((1 << width) - 1)).all()
    assert (quotient.restore(y, width) == x).all()
    assert len(np.unique(y)) == len(np.unique(x))


@pytest.mark.parametrize(("bits", "n"), [(1, 2), (5, 3), (18, 3), (21, 3), (22, 3), (32, 3), (30, 2), (33, 2), (40, 2)])
def test_filters_keep_everything(bits, n):
    pick = np.random.default_rng(bits * n)
    words = [pick.integers(1, 1 << bits, 4_000).astype(np.uint64) for _ in range(n)]
    for w in words:
        w[:1_500] = np.minimum(w[0], 1 << bits)  # a frequent n-gram
    expected = Counter(zip(*[w.tolist() for w in words]))
    _, width = quotient.layout(n, bits)
    filters = []
    for a, b in ((0, 1_000), (1_000, 1_001), (1_001, 4_000)):
        lower, upper = quotient.pack_ids([w[a:b] for w in words], bits)
        filters.append(quotient.encode(*quotient.counted(quotient.permute(lower, width), upper), width))
    lower, upper, counts = quotient.merge(filters)
    ids = quotient.unpack_ids(quotient.restore(lower, width), upper, n, bits)
    assert {tuple(i): c for i, c in zip(ids.tolist(), counts.tolist())} == expected


def test_filters_are_compact():
    pick = np.random.default_rng(1)
    words = [pick.integers(1, 1 << 18, 100_000).astype(np.uint64) for _ in range(2)]
    lower, upper = quotient.pack_ids(words, 18)
    entries = quotient.counted(quotient.permute(lower, 36), upper)
    assert len(quotient.encode(*entries, 36)) < 5 * len(entries[0])


def test_ids_too_wide_are_refused():
    with pytest.raises(ValueError, match="do not fit"):
        quotient.layout(3, 40)


def plain_phrases(docs, least=10, percent=50, top=2_000, longest=3):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang][tuple(words[i : i + n])] += 1
    out = []
    for lang, c in counts.items():
        candidates = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        best = []
        for g, a in candidates.items():
            inside = lambda h: any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
            if any(len(h) > len(g) and 100 * b >= percent * a and inside(h) for h, b in candidates.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (c[g[:k]] * c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
            best.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top]):
            out.append((lang, rank + 1, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def spoken(spark, texts, **options):
    df = spark.createDataFrame(texts, "lang string, text string").repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


def made_texts(n, seed):
    pick = random.Random(seed)
    vocabulary = ["The", "cat", "sat", "on", "mat", "été", "中文", "x"]
    signs = [" ", " ", " ", "\t", "  ", ". ", ", ", "\n", " ? "]
    return [(pick.choice(["en", "en", "fr", None]), "".join(pick.choice(vocabulary) + pick.choice(signs) for _ in range(pick.randrange(60)))) for _ in range(n)] + [
        ("en", None), ("fr", ""), ("xx", "only once")
    ]


@pytest.mark.parametrize("longest", [3, 4])
def test_phrases_of_made_texts(spark, longest):
    texts = made_texts(150, longest)
    assert spoken(spark, texts, max_words=longest) == plain_phrases(texts, longest=longest)


def test_phrases_over_many_blocks_and_shards(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_CHARS", 500)
    monkeypatch.setattr(phrases, "SLICE_BYTES", 40)
    monkeypatch.setattr(phrases, "SHARD_WORDS", 50)
    texts = made_texts(100, 9)
    assert spoken(spark, texts, top=7) == plain_phrases(texts, top=7)


def test_phrases_of_awkward_and_of_no_texts(messy, nothing):
    found = sorted(tuple(r) for r in phrases.collocations(messy).collect())
    assert found == plain_phrases([(d["lang"], d["text"]) for d in rows(messy)])
    assert phrases.collocations(nothing).count() == 0
