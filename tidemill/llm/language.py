"""Language identification by hyperdimensional letter n-gram profiles."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Components of a hypervector.
DIMENSIONS = 1024
UNKNOWN = "und"
_SYMBOLS = 512  # letter vectors; letters share them by code point
_SPACE = 0


def _letter_table() -> np.ndarray:
    """Code point -> symbol; 0 for what is no letter."""
    table = np.zeros(0x110000, dtype=np.int64)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] == "L":
            table[c] = 1 + c % (_SYMBOLS - 1)
    return table


class Profiler:
    """Turns texts into bundles of n-gram vectors; an n-gram binds its letters' vectors, each permuted by its place."""

    _table: np.ndarray | None = None

    def __init__(self, dimensions: int = DIMENSIONS):
        rng = np.random.default_rng(7)
        self.letters = rng.choice(np.array([-1, 1], dtype=np.int8), (_SYMBOLS, dimensions))
        if Profiler._table is None:
            Profiler._table = _letter_table()

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        a, rest = np.divmod(grams, _SYMBOLS * _SYMBOLS)
        b, c = np.divmod(rest, _SYMBOLS)
        return np.roll(self.letters, 2, axis=1)[a] * np.roll(self.letters, 1, axis=1)[b] * self.letters[c]

    def bundles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A bundle for each text, and the number of its letters."""
        out = np.zeros((len(texts), self.letters.shape[1]), dtype=np.float32)
        letters = np.zeros(len(texts), dtype=np.int64)
        at = 0
        while at < len(texts):
            some, size = [], 0
            while at + len(some) < len(texts) and len(some) < 64 and (not some or size + len(texts[at + len(some)]) <= 400_000):
                some.append(texts[at + len(some)].lower())
                size += len(some[-1])
            if len(some) == 1 and size > 4_000_000:  # a very long text stands alone: a bundle is a sum, so add up its stretches
                whole, last, total = f" {some[0]} ", np.zeros(0, dtype=np.int64), np.zeros(out.shape[1])
                for k in range(0, len(whole), 1_000_000):
                    new = self._symbols(whole[k : k + 1_000_000])
                    letters[at] += np.count_nonzero(new)
                    s = np.concatenate([last, new])
                    s, doc = self._squeezed(s, np.zeros(len(s), dtype=np.int64))
                    total += self._sum(s, doc, 1)[0]
                    last = s[-2:]  # what n-grams over the cut begin with
                out[at] = total
            else:
                spaced = [f" {t} " for t in some]
                s, doc = self._symbols("".join(spaced)), np.repeat(np.arange(len(some)), [len(t) for t in spaced])
                letters[at : at + len(some)] = np.bincount(doc[s > 0], minlength=len(some))
                out[at : at + len(some)] = self._sum(*self._squeezed(s, doc), len(some))
            at += len(some)
        return out, letters

    def _symbols(self, text: str) -> np.ndarray:
        return Profiler._table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]

    def _squeezed(self, s: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of what is no letter become one symbol."""
        keep = np.concatenate(([True], (s[1:] > 0) | (s[:-1] > 0) | (doc[1:] != doc[:-1])))
        return s[keep], doc[keep]

    def _sum(self, s: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        if len(s) < 3:
            return np.zeros((n, self.letters.shape[1]), dtype=np.float32)
        code = (s[:-2] * _SYMBOLS + s[1:-1]) * _SYMBOLS + s[2:]
        code, of = code[doc[:-2] == doc[2:]], doc[:-2][doc[:-2] == doc[2:]]
        grams, place = np.unique(code, return_inverse=True)
        counts = np.bincount(of * len(grams) + place, minlength=n * len(grams)).reshape(n, len(grams))
        counts[:, grams == 0] = 0
        return counts.astype(np.float32) @ self.vectors(grams).astype(np.float32)


_PROFILERS: dict[int, Profiler] = {}


def profiler(dimensions: int) -> Profiler:
    if dimensions not in _PROFILERS:
        _PROFILERS[dimensions] = Profiler(dimensions)
    return _PROFILERS[dimensions]


def held_out(docs: DataFrame) -> DataFrame:
    """Adds held_out: crc32 of doc_id as text leaves 2 modulo 4. A null doc_id is not held out."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))


def learn(docs: DataFrame, dimensions: int = DIMENSIONS, train_docs: int | None = None) -> tuple[list[str], np.ndarray]:
    """A prototype for each non-null lang: the mean of its documents' unit bundles, less the mean of all languages.

    Learns from every row of doc_id, text and lang, however many there are. A caller may ask for less with train_docs: of
    a language with more rows, those whose hash of doc_id falls under the share that makes that many. Sums are taken in
    the executors: what reaches the driver is a row for each language and component, not for each document."""
    known = docs.where(F.col("lang").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    common.bound_batches(docs.sparkSession)
    if train_docs is not None and (counts := {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}):
        share = F.coalesce(*[F.when(F.col("lang") == lang, min(1.0, train_docs / n)) for lang, n in counts.items()])
        draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_003)) / 1_000_003
        known = known.where(draw < share)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = profiler(dimensions)
        total: dict[str, np.ndarray] = {}
        for batch in common.pieces(batches):
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            bundles, _ = p.bundles([t or "" for t in batch.column(0).to_pylist()])
            bundles /= np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-9)
            for lang in set(langs):
                total[lang] = total.get(lang, 0) + bundles[langs == lang].sum(axis=0, dtype=np.float64)
        if total:
            yield pa.RecordBatch.from_pydict({"lang": list(total), "parts": [v.tolist() for v in total.values()]})

    parts = known.select("text", "lang").mapInArrow(sums, "lang string, parts array<double>")
    summed = parts.select("lang", F.posexplode("parts").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found = summed.toPandas()
    langs = sorted(found.lang.unique())
    if not langs:
        return [], np.zeros((0, dimensions))
    at = {lang: i for i, lang in enumerate(langs)}
    out = np.zeros((len(langs), dimensions))
    for lang, i, x in found.itertuples(index=False):
        out[at[lang], i] = x
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    mean = out.mean(axis=0) if len(langs) > 1 else 0
    out = out - mean  # what all languages share tells none apart
    return langs, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Adds lang_pred and score to docs (a clashing column of that name is replaced): the prototype with the greatest
    cosine to the document's bundle, and that cosine where positive, else 0. Only the text is looked at.

    A text that is null or has no letter, or any text if no language was learned, is `und` with score 0. Ties go to
    the language that sorts first. Whole texts are read, in stretches if very long. Rows stay where they are."""
    common.bound_batches(docs.sparkSession)
    langs, prototypes = model
    dimensions = prototypes.shape[1]
    base = docs.drop("lang_pred", "score")
    fields = [*base.schema.fields]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = profiler(dimensions)
        m = prototypes.T.astype(np.float32)
        for batch in common.pieces(batches):
            text = batch.column(batch.schema.get_field_index("text"))
            bundles, letters = p.bundles([t or "" for t in text.cast(pa.string()).to_pylist()])
            if langs:
                cosines = bundles @ m / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-9)
                best = cosines.argmax(axis=1)
                score = np.clip(cosines[np.arange(len(best)), best], 0, 1).astype(np.float64)
            else:
                best, score = np.zeros(len(letters), dtype=np.int64), np.zeros(len(letters))
            pred = [langs[b] if n and langs else UNKNOWN for b, n in zip(best, letters, strict=True)]
            score[letters == 0] = 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql import types as T

    return base.mapInArrow(predict, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def language_id(docs: DataFrame, dimensions: int = DIMENSIONS, train_docs: int | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from all that are not held out."""
    marked = held_out(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    model = learn(marked.where(~F.col("held_out")), dimensions, train_docs)
    return identify(marked.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")
