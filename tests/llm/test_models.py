"""Language identification, exact search, chat trees and the pipeline."""

import hashlib
import zlib

import numpy as np
import pytest

from tidemill.llm import chat, common, language, queries, topk


def test_languages_are_told_apart_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.language_id(docs, train_docs=200).toPandas().merge(docs.select("doc_id", "lang").toPandas())
    held = got[got.held_out]
    assert len(held) > 150 and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_edges(odd_docs, no_docs):
    assert language.language_id(no_docs).count() == 0
    got = language.language_id(odd_docs).toPandas()
    assert len(got) == odd_docs.count()
    assert set(got[got.doc_id.isin([4, 5, 6, 13])].lang_pred) == {"und"}
    unlabelled = language.language_id(odd_docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")).toPandas()
    assert set(unlabelled.lang_pred) == {"und"}


def test_prediction_does_not_look_at_labels(spark, sample):
    model = language.learn(sample)
    a = language.identify(sample, model).orderBy("doc_id").toPandas()
    b = language.identify(sample.selectExpr("doc_id + 5 AS doc_id", "text", "'xx' AS lang"), model).orderBy("doc_id").toPandas()
    assert list(a.lang_pred) == list(b.lang_pred) and np.allclose(a.score, b.score)


def test_a_bundle_is_the_sum_over_stretches():
    p = language.profiler(256)
    text = "der die das und " * 300_000
    whole, n = p.bundles([text])
    part, m = p.bundles([text[: len(text) // 4]])
    assert n[0] >= 12 * 300_000 and m[0] == 12 * 75_000
    cos = (whole @ part.T)[0, 0] / np.linalg.norm(whole) / np.linalg.norm(part)
    assert cos > 0.9999


def test_a_very_long_text_takes_nothing_from_itself_or_its_neighbours(spark):
    p = language.profiler(256)
    de, en = "der hund und die katze ", "the dog and the cat "
    texts = [en, de, de * 190_000, en, "", en * 210_000, de]
    got, n = p.bundles(texts)
    assert list(n) == [sum(c.isalpha() for c in t) for t in texts]
    assert (got == np.concatenate([p.bundles([t])[0] for t in texts])).all()
    gaps, _ = p.bundles([("der hund" + " " * 1500) * 3000])  # longer than four stretches, which end in gaps
    assert (gaps == p.bundles(["der hund " * 3000])[0]).all(), "runs of other characters are one, at a cut too"
    docs = spark.createDataFrame([(i, t, "de" if t[:3] == "der" else "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1)
    found = language.identify(docs, language.learn(docs)).orderBy("doc_id").collect()
    assert [r.lang_pred for r in found] == ["en", "de", "de", "en", "und", "en", "de"]


def test_every_document_is_learned_from_however_many_there_are(spark):
    """5,000 documents a language, three quarters of them not held out; predictions of a plain mean over all of these."""
    rng = np.random.default_rng(5)
    words = {k: ["".join(rng.choice(list(k), 4)) for _ in range(300)] for k in ("abcdefgh", "efghijkl")}
    rows = [(i, " ".join(rng.choice(words[k], 6)), k) for i, k in enumerate(list(words) * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    p, learned = language.profiler(128), {}
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    for k in words:
        some = [t for i, t, lang in rows if lang == k and zlib.crc32(str(i).encode()) % 4 != 2]
        assert len(some) > 3500
        learned[k] = unit(unit(p.bundles(some)[0].astype(float)).sum(axis=0))
    mean = sum(learned.values()) / 2
    plain = list(learned), np.array([unit(v - mean) for v in learned.values()])
    want = language.identify(docs, plain).orderBy("doc_id").toPandas()
    got = language.language_id(docs, dimensions=128).orderBy("doc_id").toPandas()
    assert np.abs(got.score - want.score).max() < 1e-6 and list(got.lang_pred) == list(want.lang_pred)


@pytest.mark.parametrize("block", [7, 1024])
def test_top_k_against_all_products(spark, block):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(6)] + [(220, rows[3][1]), (220, rows[3][1])]
    odd = [(300, None), (301, []), (302, [1.0] * 7 + [float("nan")]), (303, [1.0] * 7 + [float("inf")]), (304, [1.0] * 7 + [None]), (None, [1.0] * 8), (320, [0.5] * 5), (321, [0.25] * 5)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    v = topk.scaled(df)
    got = topk.top_k(v, v.where("vec_id % 20 = 0"), 5, block=block).collect()
    good = [(i, np.floor(64 * np.array(x)).astype(int)) for i, x in rows + odd[-2:]]
    want = {}
    for q, x in good:
        if q % 20 == 0:
            s = sorted((-int(x @ y), i) for i, y in good if i != q and len(y) == len(x))[:5]
            want[q] = [(r + 1, i, -n) for r, (n, i) in enumerate(s)]
    found: dict = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {k: sorted(x) for k, x in found.items()} == want


@pytest.mark.parametrize("big", [1e8, 3e11, 1e15])
def test_top_k_keeps_vectors_with_large_components(spark, big):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(60)]
    rows += [(60, [big, -big] + [0.5] * 6), (61, [big, big] + [0.25] * 6)]
    v = topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found: dict = {}
    for r in topk.top_k(v, v.where("vec_id % 20 = 0"), 5).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = [(i, [int(np.floor(64 * c)) for c in x]) for i, x in rows]
    for q, x in whole[::20]:
        s = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in whole if i != q)[:5]
        assert sorted(found[q]) == [(r + 1, i, -n) for r, (n, i) in enumerate(s)]


def test_top_k_of_nothing(spark):
    v = topk.scaled(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(v, v).count() == 0


def packed_block(x, ids, pivots):
    d = topk.to_pivots(x, pivots)
    norm = float((x.astype(float) ** 2).sum(axis=1).max())
    return topk.Block(x.shape[1], ids.astype("<i8").tobytes(), x.astype("<i8").tobytes(), d.tobytes(), d.min(axis=0).tobytes(), d.max(axis=0).tobytes(), norm, False)


def test_pivots_spare_candidates_and_change_nothing():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-3, 4, (300, 16)) + c for c in rng.integers(-60, 60, (6, 16))])
    ids = np.arange(len(x))
    found = []
    for pivots in (topk.spread_out(x, 12), np.zeros((0, 16))):
        s = topk.Search(packed_block(x[:10], ids[:10], pivots), 5)
        s.visit([packed_block(x[a : a + 100], ids[a : a + 100], pivots) for a in range(0, len(x), 100)])
        found.append(s)
    assert (found[0].scores == found[1].scores).all() and (found[0].ids == found[1].ids).all()
    assert found[0].evaluated < found[1].evaluated / 3
    want = np.sort(np.where(ids[None] == ids[:10, None], topk.NONE, x[:10] @ x.T), axis=1)[:, :-6:-1]
    assert (found[0].scores == want).all()


NASTY = queries.CONTROL


def check_chat(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, node int")
    trees = common.stored(chat.chat_trees(df, **kw), "chat")
    got = {r.conv_id: r for r in chat.read_back(trees).collect()}
    convs: dict = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] if r[1] is not None else -1, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        said = "".join(x for r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(said))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.format_turn(a, b)[0]) for a, b in turns)
    return trees.collect()


def test_chat_round_trip(spark):
    rows = [(-1, 0, "user", NASTY), (-1, 1, "assistant", NASTY), (1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "x" * 9)]
    rows += [(2, 0, "system", "s"), (2, 1, "user", "hi"), (2, 2, "assistant", "other"), (3, 0, "us\ner\\n\\<|", "<|\\|a\\\\<\\| \n\\n"), (3, 1, None, None), (4, 0, "assistant", ""), (4, 0, "assistant", ""), (None, 0, "user", "é中\U0001f600")]
    trees = check_chat(spark, rows)
    assert sum(t.text.count("<|im_start|>system") for t in trees) == 1, "a shared first turn is emitted once"
    for t in trees:
        for n in t.nodes:
            if n.parent >= 0:
                p = t.nodes[n.parent]
                assert n.position == p.position + p.end - p.start and n.token_position == p.token_position + p.token_end - p.token_start
            assert sum(a.end - a.start for a in n.ancestors) == n.token_position
    check_chat(spark, rows, sequence_chars=1)


def test_chat_of_nothing(spark):
    assert chat.chat_trees(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "\\\\n", "a<|b", "<|im_end|>", "\\<|", "<<||", "n\\\n"])
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_pipeline_stages(spark, odd_docs, no_docs):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        assert stage(spark, no_docs.select(*P.COLUMNS), sf).count() == 0, name
        stage(spark, odd_docs, sf).count()
        if name != P.STAGES[-1][0]:
            assert out.columns == P.COLUMNS
            n = docs.count()
            docs = common.stored(out, name)
            assert 0.8 * n * 0.8 < docs.count() <= n, f"{name} keeps clean documents"
    ids = [r.doc_id for r in docs.collect()]
    assert len(set(ids)) == len(ids)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    from tidemill.llm import decontaminate

    assert decontaminate.decontaminate(docs, bench).where("n_items > 0").count() == 0


def test_chat_shares_turns_however_deep(spark):
    said = {c: [(t, f"turn {t}") for t in range(20)] for c in (1, 2, 3, 4)}
    for c in (2, 4):
        said[c][16:] = [(t, f"turn {t} of others") for t in range(16, 20)]
    rows = [(c, t, "user", x) for c, turns in said.items() for t, x in turns]
    got = chat.chat_trees(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)).collect()
    assert sum(len(r.leaves) for r in got) == 4
    for r in got:
        turns = [(n.parent, r.text[n.start : n.end]) for n in r.nodes]
        assert len(set(turns)) == len(turns)
    assert any(len(r.leaves) > 2 for r in got)


def test_bundles_and_cosines_against_a_letter_at_a_time(spark):
    """The profiles and predictions of a plain loop: each trigram's letters permuted by place, bound, and added up."""
    d = 128
    p = language.profiler(d)
    symbol = lambda c: p._table[ord(c)]

    def bundle(text):
        out, before = np.zeros(d), []
        symbols = [symbol(c) for c in f" {text.lower()} "]
        squeezed = [x for i, x in enumerate(symbols) if i == 0 or x or symbols[i - 1]]  # runs of other characters are one
        for a, b, c in zip(squeezed, squeezed[1:], squeezed[2:], strict=False):
            if a or b or c:
                out += np.roll(p.letters[a], 2).astype(int) * np.roll(p.letters[b], 1) * p.letters[c]
        return out

    texts = {"aa": ["der hund und die katze", "ein Haus, und ein Baum!"], "bb": ["the dog and the cat", "a house -- and a tree"], "cc": ["el perro y el gato", "una casa 12 y un árbol"]}
    for some in texts.values():
        got, _ = p.bundles(some)
        assert np.allclose(got, [bundle(t) for t in some])
    unit = lambda v: v / np.linalg.norm(v)
    proto = {k: unit(sum(unit(bundle(t)) for t in some)) for k, some in texts.items()}
    mean = sum(proto.values()) / 3
    proto = {k: unit(v - mean) for k, v in proto.items()}
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, some in texts.items() for t in some)]
    asked = [(10 + i, t, None) for i, t in enumerate(["und der Baum", "the tree", "gato y casa", "zzz", "9"])]
    docs = spark.createDataFrame(rows + asked, "doc_id long, text string, lang string")
    langs, learned = language.learn(docs, dimensions=d)
    assert langs == sorted(texts) and np.allclose(learned, [proto[k] for k in langs])
    for r in language.identify(docs, (langs, learned)).collect():
        if not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        cosines = {k: float(unit(bundle(r.text)) @ v) for k, v in proto.items()}
        best = max(cosines, key=cosines.get)
        assert r.lang_pred == best and abs(r.score - max(cosines[best], 0)) < 1e-5


def test_chat_without_ids_with_repeats_and_very_long(spark):
    rows = [(None, 1, "assistant", "b"), (None, 0, "user", "a"), (None, 0, "user", "a"), (7, 0, "user", "x"), (7, 0, "user", "x"), (7, None, "assistant", None)]
    rows += [(8, t, "user" if t % 2 == 0 else "assistant", f"{t} " + "word " * 50) for t in range(900)] + [(9, 0, "user", "long " * 60_000), (9, 1, "assistant", "y" * 250_000)]
    check_chat(spark, rows)


def kept_by(stage, spark, rows, sf="/root/testdata/sf0.001"):
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key int, text_hash string")
    return sorted(((r.doc_id, r.text) for r in stage(spark, docs, sf).collect()), key=str)


def test_pipeline_stages_lose_no_row_for_its_id(spark):
    """Null ids, ids that are repeated with other texts, and rows that are repeated: who stays, exactly."""
    import corpus_pipeline as P

    one, two, three = (" ".join(f"{x}{i}" for i in range(90)) for x in ("alpha", "beta", "gamma"))
    rows = [(None, one), (None, two), (7, three), (7, "short words only"), (8, "other short words")]
    assert kept_by(P.near_dedup, spark, rows) == sorted(rows, key=str)
    assert kept_by(P.suffix_array_dedup, spark, rows) == sorted(rows, key=str)
    assert kept_by(P.decontamination, spark, rows) == sorted(rows, key=str)
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first().text
    tainted = [(None, f"{one} {item}"), (7, item), (8, f"x {item}")]
    assert kept_by(P.decontamination, spark, rows + tainted) == sorted(rows, key=str), "others with their ids stay"
    twice = [(1, one), (1, one), (None, two), (None, two), (3, three), (3, f"{three} and something new")]
    assert kept_by(P.near_dedup, spark, twice) == sorted([(1, one), (None, two), min(twice[4:], key=lambda r: spark.range(1).selectExpr(f"xxhash64('{r[1]}') AS h").first().h)], key=str)
    assert kept_by(P.suffix_array_dedup, spark, twice) == [(3, " and something new")], "copies of 200 bytes go from all rows that hold them"
    assert kept_by(P.decontamination, spark, twice) == sorted(twice, key=str)
    odd = [(None, None), (1, ""), (2, " \n"), (3, "12345 67890"), (4, "the water and the land"), (None, "der Hund und die Katze und das Haus")]
    got = kept_by(P.language_id, spark, [*odd, *[(20 + i, "the house and the tree " * 3) for i in range(5)]])
    assert (4, odd[4][1]) in got and not {None, "", " \n", "12345 67890"} & {t for _, t in got}
    assert kept_by(P.suffix_array_dedup, spark, odd) == sorted([(None, "") if t is None else (d, t) for d, t in odd], key=str)


def test_pipeline_cleans_up(spark, tmp_path):
    import corpus_pipeline as P

    for name in ("documents", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(60).write.parquet(f"{tmp_path}/{name}.parquet")
    before = common.scratch_tables()
    out = P.run(spark, str(tmp_path))
    assert out.count() >= 30
    assert [p for p in common.scratch_tables() if p not in before] == [out.stored_at]
