"""Near duplicates, suffix and substring removal and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemill.llm import common, decontaminate, hashing, neardup, repeats, substring_dedup, suffix_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")
TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def null_first(x):
    return common.NULL_ID if x is None or x != x else int(x)


# near duplicates


def shingles(text, k):
    w = WORD.findall(low(text))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent):
    """rows: (doc_id, text); rows of one doc_id are one node."""
    parent = {null_first(d): null_first(d) for d, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    sets = [(null_first(d), shingles(t, k)) for d, t in rows]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= percent * (len(x) + len(y) - n):
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
    return {d: find(d) for d in parent}


def check_near(docs, k, percent):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_components(rows, k, percent)
    got = neardup.near_duplicates(docs, k, percent).collect()
    assert Counter((null_first(r.doc_id), r.n_shingles, null_first(r.component_id), r.kept) for r in got) == Counter((null_first(d), len(shingles(t, k)), want[null_first(d)], null_first(d) == want[null_first(d)]) for d, t in rows)
    return got


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(sample, k, percent):
    check_near(sample, k, percent)


def test_near_duplicates_chain_and_hot_group(spark):
    """A large group of copies with edits, whose links do not all lead to the least id, and a chain."""
    rng = random.Random(1)
    base = [f"t{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for j in rng.sample(range(120), rng.choice([0, 1, 2, 3, 6, 10])):
            w[j] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(100)]
    for i in range(12):
        rows.append((1000 + i, " ".join(chain[: 100 - 0] if i == 0 else [*(f"n{j}" for j in range(i)), *chain[i:]])))
    check_near(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)


def test_near_duplicates_edges(odd_docs, no_docs):
    check_near(odd_docs, 3, 85)
    assert neardup.near_duplicates(no_docs).count() == 0


def test_odd_sketches_estimate_similarity(spark):
    rng = np.random.default_rng(0)
    for n in (100, 600, 5000):
        for share in (0.5, 0.85, 0.95, 1.0):
            both = hashing.mixed(rng.integers(0, 2**63, int(2 * n * share / (1 + share)), dtype=np.uint64))
            a, b = (np.unique(np.concatenate((both, hashing.mixed(rng.integers(0, 2**63, n - len(both), dtype=np.uint64))))) for _ in range(2))
            s, count, _ = neardup.odd_sketches([a, b])
            bits = 64 * neardup.SKETCH_LONGS
            apart = int(np.unpackbits((s[0] ^ s[1]).view(np.uint8)).sum())
            t = -bits / 2 * np.log(max(1 - 2 * apart / bits, 1e-9))
            true = len(both) / (2 * n - len(both))
            assert abs((count.sum() - t) / 2 / count.max() - true) < 0.08 or share == 0.5


@pytest.mark.parametrize("percent", [80, 85])
def test_sketches_keep_pairs_at_the_threshold(spark, percent):
    """Of random pairs with the least similarity that counts, the sketches rule out next to none, at any set size."""
    rng = np.random.default_rng(percent)
    rows, each = [], 1500
    for union in (40, 60, 100, 200, 300, 500, 1000, 1600, 3000):
        common_ = -(-percent * union // 100)
        for _ in range(each):
            x = np.unique(hashing.mixed(rng.integers(0, 2**63, union, dtype=np.uint64)))
            rng.shuffle(x)
            cut = int(rng.integers(common_, union + 1))
            a, b = np.sort(x[:cut]), np.sort(np.concatenate((x[:common_], x[cut:])))
            s, count, whole = neardup.odd_sketches([a, b])
            rows.append((union, len(a), len(b), s[0].tolist(), s[1].tolist(), int(count[0]), int(count[1]), *(None if w is None else w.tolist() for w in whole)))
    pairs = spark.createDataFrame(rows, "u int, a_n long, b_n long, a_sketch array<long>, b_sketch array<long>, a_samples int, b_samples int, a_whole array<long>, b_whole array<long>")
    lost = {r["u"]: r["count"] for r in pairs.where(~neardup.may_be_similar("a_", "b_", percent / 100)).groupBy("u").count().collect()}
    assert sum(lost.values()) <= 2, lost


def test_pipeline_drops_only_near_copies(spark):
    """Rows without an id, and rows that repeat one with another text, are documents of their own."""
    import corpus_pipeline

    texts = {x: " ".join(f"{x}{i}" for i in range(80)) for x in "abcde"}
    rows = [(None, texts["a"]), (None, texts["b"]), (1, texts["a"] + " more"), (2, texts["b"]), (3, texts["c"]), (3, texts["d"]), (3, texts["d"]), (4, texts["d"]), (9, texts["e"]), (8, texts["e"])]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == Counter([(None, texts["a"]), (None, texts["b"]), (3, texts["c"]), (3, texts["d"]), (8, texts["e"])])


# suffixes


def check_match(found, want):
    n, whole, masks = found
    got = [[True] * int(n[i]) if whole[i] else masks[i].tolist() if i in masks else [False] * int(n[i]) for i in range(len(n))]
    assert got == want


def brute_suffix(rows, window):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + window] for b in texts for i in range(len(b) - window + 1))
    out = Counter()
    for (d, _), b in zip(rows, texts, strict=True):
        m = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                m[i : i + window] = b"\1" * window
        kept = bytes(x for x, y in zip(b, m, strict=True) if not y)
        out[(null_first(d), len(b), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize(("hot", "proven", "window"), [(512, 16, 200), (1, 16, 200), (2, 1, 24), (512, 1000, 24)])
def test_suffix_dedup(spark, odd_docs, sample, monkeypatch, hot, proven, window):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "PROVEN", proven)
    docs = sample.select("doc_id", "text").limit(80).union(odd_docs.where("length(text) < 5000 OR text IS NULL").select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((null_first(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs, window).collect())
    assert got == brute_suffix(rows, window)


def test_suffix_dedup_edges(odd_docs, no_docs):
    assert suffix_dedup.suffix_dedup(no_docs).count() == 0
    got = suffix_dedup.suffix_dedup(odd_docs, with_text=True).toPandas()
    assert len(got) == odd_docs.count()
    assert (got.kept_text.str.len() <= got.n_bytes).all()


def test_long_documents_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 300)
    rng = random.Random(5)
    part = "".join(rng.choice("abcd ") for _ in range(700))
    rows = [(1, "x" * 90 + part + "y" * 250), (2, part[100:600] + "z"), (3, part[:150])]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_suffix(rows, 50)


def test_suffix_sort_orders_suffixes_and_settles_false_hashes(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    s = suffix_dedup.Suffixes(data, 30)
    at = np.arange(300)
    order = suffix_dedup.merge_sort(s, at, np.zeros(300, dtype=int))
    raw = data.tobytes()
    assert [raw[i : i + 30] for i in at[order]] == sorted(raw[i : i + 30] for i in at)
    bodies = [b"aaaa1", b"aaab1", b"aaaa1"]
    monkeypatch.setattr(hashing, "BYTE_VALUES", np.ones(256, dtype=np.uint64))  # every hash agrees
    found = suffix_dedup.match(np.zeros(3, dtype=np.int64), np.arange(3), bodies, np.zeros(3, dtype=np.int64), 5, False)
    check_match(found, [[True], [False], [True]])


# words


def brute_words(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (d, _), w in sorted(zip(rows, words, strict=True), key=lambda x: null_first(x[0][0])):
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), null_first(d))
    out = Counter()
    for (d, _), w in zip(rows, words, strict=True):
        m = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < null_first(d):
                m[i : i + window] = [True] * window
        out[(null_first(d), len(w), sum(m), hashlib.sha256(" ".join(x for x, y in zip(w, m, strict=True) if not y).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize(("hot", "proven", "window"), [(512, 16, 50), (1, 16, 50), (2, 1, 6), (512, 1000, 6)])
def test_substring_dedup(spark, odd_docs, sample, monkeypatch, hot, proven, window):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "PROVEN", proven)
    docs = sample.select("doc_id", "text").union(odd_docs.select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((null_first(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs, window).collect())
    assert got == brute_words(rows, window)


def test_substring_dedup_of_nothing(no_docs):
    assert substring_dedup.substring_dedup(no_docs).count() == 0


def test_subtrees_settle_false_hashes(monkeypatch):
    """Where every word and every sequence has one hash, the words themselves decide."""
    bodies = [b"a b c", b"a b d", b"a b c", b"x y z"]
    for broken in (False, True):
        if broken:
            monkeypatch.setattr(hashing, "mixed", lambda h: h * np.uint64(0))
        found = substring_dedup.match(np.zeros(4, dtype=np.int64), np.arange(4), bodies, np.zeros(4, dtype=np.int64), 3, True)
        check_match(found, [[False], [False], [True], [False]])


def test_subtree_finds_deep_nodes():
    words = hashing.mixed(np.array([1, 2, 3, 1, 2, 3, 1, 2, 9], dtype=np.uint64))
    tree = substring_dedup.Subtree(hashing.Prefix(words), np.arange(7), np.zeros(7, dtype=int), 3)
    groups = Counter(tree.node[tree.node >= 0].tolist())
    assert sorted(groups.values()) == [2, 2, 2] and tree.node[6] < 0 and (tree.node[[0, 3]] >= 0).all()


# decontamination


def brute_hits(rows, items, window=8):
    wins = {}
    for i, t in items:
        w = TERM.findall(low(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = Counter()
    for d, t in rows:
        w, hit, found = TERM.findall(low(t)), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if s := wins.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= s
        out[(null_first(d), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2)] += 1
    return out


def test_decontamination(spark, odd_docs, sample):
    bench = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    bench += [(900, "alpha1 beta1"), (901, ""), (902, None), (903, "ab ab ab"), (904, "w5x5 w6x6 w7x7 w8x8 w9x9 w10x10 w11x11 w12x12 w13x13"), (904, "ONE"), (905, "中文"), (905, "中文")]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in bench], "item_id long, text string, doc long")
    docs = sample.select("doc_id", "text").union(odd_docs.select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.decontaminate(docs, benchmark).collect()
    assert Counter((null_first(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute_hits(rows, bench)


def test_decontamination_edges(odd_docs, no_docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(no_docs, none).count() == 0
    got = decontaminate.decontaminate(odd_docs, none).toPandas()
    assert len(got) == odd_docs.count() and not got.contaminated.any() and (got.n_hit == 0).all()


def test_phrases_and_proximity(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f g h y"), (2, "a z b q q q a")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "A b c d e f g h")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.phrase_matches(docs, items).collect()] == [(1, "7", 1, 8)]
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    got = sorted(tuple(r) for r in decontaminate.proximity_matches(docs, pairs, 2).collect())
    assert got == [(1, "a", "b", 1, 2), (2, "a", "b", 0, 2)]
