"""Packing, token files and token counts against the library and by exact round trips."""

import zlib
from collections import Counter

import numpy as np
import pytest

from tidemill.llm import common, packing, token_counts, token_files, tokens

END = np.array([2], dtype="<u4").tobytes()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()


TEXTS = ["", " ", "a", "a b", "a  b", " a b ", "a \n b", "a\nb c\n\nd", "don't 'll x we've", "x,y; z. q!? r-s", "1 2 33 4a b5", "é ü ß 中文 \U0001f600 z", "<|endoftext|> a <|endoftext|>", "tab\t x y   z", "a\x1c b \x85 c", "Ġx ĠĠy"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_those_of_the_library(library, text):
    code = tokens.encoder(tokens.tokenizer_path())
    assert code.encode(text) == library(text)
    assert code.encode_all([text, "in between", text]) == [library(text), library("in between"), library(text)]
    assert code.byte_lengths[np.frombuffer(library(text), "<u4")].sum() == len(text.encode())


def test_ids_of_whole_texts(library, sample):
    code = tokens.Encoder(tokens.tokenizer_path())
    texts = [r.text for r in sample.select("text").collect()]
    assert code.encode_all(texts) == [library(t) for t in texts]


@pytest.mark.parametrize("seed", range(6))
def test_plan_gives_each_rank_a_slot_of_its_own_and_is_best_fit(seed):
    rng = np.random.default_rng(seed)
    counts = {int(n): int(c) for n, c in zip(rng.integers(1, 101, 20), rng.integers(1, 60, 20), strict=True)}
    seen, used = {}, Counter()
    for length, first, ranks, each, sequence, offset, _ in packing.plan(counts, 100):
        for r in range(ranks):
            turn, copy = divmod(r, each)
            key = (length, first + r)
            assert key not in seen
            seen[key] = (sequence + turn, offset + copy * length)
            used[sequence + turn] += length
    assert Counter(n for n, _ in seen) == Counter(counts)
    assert max(used.values()) <= 100
    free: list[int] = []  # best-fit decreasing, a piece at a time
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fit = [r for r in free if r >= n]
        if fit:
            free.remove(min(fit))
            free.append(min(fit) - n)
        else:
            free.append(100 - n)
    assert len(used) == len(free)


def check_packed(library, docs, capacity):
    got = packing.pack(docs, capacity).toPandas()
    want = []
    for r in docs.select("doc_id", "text").collect():
        raw = library(r.text) + END
        n, at, piece = len(raw) // 4, 0, 0
        while at < n:
            size = (n - 1) % capacity + 1 if piece == 0 else capacity
            want.append((r.doc_id, piece, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)])))
            at, piece = at + size, piece + 1
    key = lambda t: tuple(-1 if x is None or x != x else int(x) for x in t)
    assert sorted(map(key, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(map(key, want))
    g = got.sort_values(["sequence_id", "offset"])
    assert (g.groupby("sequence_id").length.cumsum() - g.length == g.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= capacity
    return got


def test_pack(library, sample):
    got = check_packed(library, sample, 1024)
    assert got.sequence_id.nunique() <= -(-int(got.length.sum()) // 1024) * 1.02 + 1


def test_pack_odd_documents(library, odd_docs, no_docs):
    check_packed(library, odd_docs, 64)
    assert packing.pack(no_docs).count() == 0


def test_token_files_round_trip(library, spark, odd_docs, no_docs):
    where = common.scratch_path(spark, "files")
    manifest = token_files.write_token_files(odd_docs, where, frame_ids=100)
    got = token_files.read_token_files(manifest).toPandas().sort_values("start")
    ids = [common.NULL_ID if x != x else int(x) for x in got.doc_id]
    assert ids == sorted(ids)
    assert (got.start == got.n_tokens.cumsum() - got.n_tokens).all()
    want = Counter((r.doc_id if r.doc_id is not None else common.NULL_ID, zlib.crc32(library(r.text) + END)) for r in odd_docs.collect())
    assert Counter(zip(ids, got.ids_crc32, strict=True)) == want
    path = next(r.path for r in manifest.collect() if r.lowest is None or r.lowest <= 8 <= r.highest)
    text = next(r.text for r in odd_docs.collect() if r.doc_id == 8)
    assert token_files.read_documents(path, [8])[8].tobytes() == library(text) + END
    assert token_files.read_token_files(token_files.write_token_files(no_docs, where)).count() == 0


def test_a_reader_decompresses_only_what_it_is_asked_for_and_sees_damage(tmp_path):
    path = tmp_path / "x.zst"
    with open(path, "wb") as f:
        w = token_files.Writer(f, 10)
        for d in range(20):
            w.add(d, np.arange(d, d + 7, dtype="<u4").tobytes())
        w.close()
    import zstandard

    with open(path, "rb") as f:  # any zstandard reader skips the index and the table
        assert len(zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()) == 20 * 7 * 4
    data = bytearray(path.read_bytes())
    with open(path, "rb") as f:
        at = token_files.Reader(f, len(data)).at
    data[int(at[3]) + 12] ^= 255
    path.write_bytes(bytes(data))
    assert list(token_files.read_documents(str(path), [0, 1])[1]) == list(range(1, 8))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.read_documents(str(path), [5])


@pytest.mark.parametrize("rule", token_counts.RULES)
@pytest.mark.parametrize("separator", ["\n", "e", " "])
def test_token_counts_against_offsets(odd_docs, sample, rule, separator):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    docs = sample.limit(20).selectExpr("doc_id + 1000 AS doc_id", "text").union(odd_docs.where("doc_id IN (4, 5, 6, 11, 12, 13)").select("doc_id", "text"))
    got = token_counts.token_counts(docs, rule, separator=separator).toPandas()
    for r in docs.collect():
        text, g = r.text or "", got[got.doc_id == r.doc_id].sort_values("section")
        cuts = [0] + [i + 1 for i, c in enumerate(text) if c == separator]
        if cuts[-1] != len(text) or len(cuts) == 1:
            cuts.append(len(text))
        assert list(g.char_start) == cuts[:-1] and list(g.char_end) == cuts[1:]
        n, crossing, end = Counter(), Counter(), 0
        at = [len(text[:c].encode()) for c in cuts]
        for token in t.encode(text, add_special_tokens=False).tokens:  # one character for each byte
            start, end = end, end + len(token)
            inside = [i for i in range(len(at) - 1) if at[i] < end and at[i + 1] > start]
            shares = [min(end, at[i + 1]) - max(start, at[i]) for i in inside]
            owner = {"first": inside[0], "last": inside[-1], "largest": inside[int(np.argmax(shares))]}[rule]
            n[owner] += 1
            crossing[owner] += len(inside) > 1
        assert list(g.n_tokens) == [n[i] for i in range(len(g))]
        assert list(g.n_crossing) == [crossing[i] for i in range(len(g))]


@pytest.mark.parametrize("name", [tokens.DEFAULT_TOKENIZER, tokens.DEFAULT_RANKS, "word_bpe_49k.json"])
def test_offsets_of_whole_texts(sample, name):
    """Ids and ends of either library are those of the tokenizers library's plain call."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name if name.endswith(".json") else tokens.DEFAULT_TOKENIZER))
    code = tokens.whole_encoder(public_tokenizers.path(name))
    for text in [*TEXTS, *(r.text for r in sample.select("text").limit(60).collect())]:
        ids, ends = code.encode(text)
        want = t.encode(text, add_special_tokens=False)
        assert ids.tolist() == want.ids
        if text.isascii():  # where a character is a byte, the library's offsets are in bytes
            assert ends.tolist() == [e for _, e in want.offsets]
        assert len(ends) == 0 or ends[-1] <= len(text.encode()) and (np.diff(ends) >= 0).all()


def test_token_counts_edges(odd_docs, no_docs):
    assert token_counts.token_counts(no_docs).count() == 0
    got = token_counts.token_counts(odd_docs).toPandas()
    assert len(got[got.doc_id == 4]) == 1 and got[got.doc_id == 4].n_tokens.sum() == 0
    with pytest.raises(ValueError):
        token_counts.token_counts(odd_docs, "none")


def test_added_tokens_in_texts_are_the_librarys(library, spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x" * 30 + "<|endoftext|><|endoftext|>\nend", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_packed(library, docs, 8)
    where = common.scratch_path(spark, "files")
    got = token_files.read_token_files(token_files.write_token_files(docs, where)).toPandas()
    assert dict(zip(got.doc_id, got.ids_crc32, strict=True)) == {i: zlib.crc32(library(t) + END) for i, t in enumerate(texts)}
    assert 50256 in np.frombuffer(library(texts[0]), "<u4")
    counts = token_counts.token_counts(docs).toPandas().groupby("doc_id").n_tokens.sum()
    assert counts.to_dict() == {i: len(library(t)) // 4 for i, t in enumerate(texts)}
