"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Words of a window.
WINDOW = 8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased; null has none."""
    return F.array_remove(F.split(F.coalesce(common.ascii_lower(text), F.lit("")), SEPARATORS), "")


def if_small(df: DataFrame) -> DataFrame:
    """df, made of the benchmark alone, with a broadcast hint if all its values are small enough together."""
    size = df.agg(F.sum(F.length(F.to_json(F.struct(*df.columns)))).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= common.BROADCAST_BYTES else df


def items_of(benchmark: DataFrame, window: int) -> DataFrame:
    """A row for each different item with words: item (a key), item_id as text, iw (its words), len (of its windows)."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text").cast("string")).alias("iw"))
    rows = rows.where(F.col("item_id").isNotNull() & (F.size("iw") > 0)).distinct()
    return rows.select(F.xxhash64("item_id", "iw").alias("item"), "item_id", "iw", F.least(F.size("iw"), F.lit(window)).alias("len"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The part of the index that `terms` asks for: term, doc, th, pos of every occurrence. docs: as common.doc_keys gives."""
    each = docs.select("doc", "th", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return each.join(if_small(terms.select("term").distinct()), "term").select("term", "doc", "th", "pos")


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each term stands in all documents: term, n. A term that stands nowhere has no row."""
    each = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    return each.join(if_small(terms.select("term").distinct()), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def rarest_places(items: DataFrame, counts: DataFrame) -> DataFrame:
    """For each window of each item (item, t) the places o1 and o2 of its two rarest words in the item (equal if it has one word)."""
    at = items.select("item", "iw", "len", F.explode(F.expr("sequence(0, size(iw) - len)")).alias("t"))
    each = at.select("item", "t", F.explode(F.expr("transform(sequence(0, len - 1), i -> struct(t + i AS off, iw[t + i] AS term))")).alias("x")).select("item", "t", "x.off", "x.term")
    ranked = each.join(counts, "term", "left").withColumn("r", F.row_number().over(Window.partitionBy("item", "t").orderBy(F.coalesce("n", F.lit(0)), "off")))
    return ranked.where("r <= 2").groupBy("item", "t").agg(F.min_by("off", "r").alias("o1"), F.max_by("off", "r").alias("o2"))


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """All occurrences of the benchmark's windows.

    Returns (all documents: doc_id, doc, th, n_words; hits: doc, th, item_id, start, len). Both are stored."""
    keyed = common.doc_keys(docs)
    items = common.stored(items_of(benchmark, window), "items")
    vocabulary = items.select(F.explode("iw").alias("term")).distinct()
    counts = common.stored(document_counts(keyed, vocabulary), "counts")
    places = common.stored(rarest_places(items, counts), "places")
    chosen = places.select("item", F.explode(F.array_distinct(F.array("o1", "o2"))).alias("off")).distinct()
    anchors = common.stored(chosen.join(items, "item").select("item", "off", F.expr("iw[off]").alias("term")), "anchors")
    index = common.stored(postings(keyed, anchors), "postings")
    # offset-adjusted: an item that stands in a document has all its words on one diagonal
    diagonals = index.join(if_small(anchors), "term").select("doc", "th", "item", (F.col("pos") - F.col("off")).alias("diagonal"), "off")
    lists = places.groupBy("item").agg(F.collect_set(F.struct("o1", "o2")).alias("pairs"))
    met = diagonals.groupBy("doc", "th", "item", "diagonal").agg(F.collect_set("off").alias("offs")).join(if_small(lists), "item")
    met = met.where("exists(pairs, p -> array_contains(offs, p.o1) AND array_contains(offs, p.o2))")
    met = met.join(if_small(items.select("item", F.size("iw").alias("n"))), "item")
    candidates = met.groupBy("doc", "th").agg(F.collect_list(F.struct("item", "diagonal", "n")).alias("candidates"))
    split = keyed.join(candidates, ["doc", "th"], "left").select("doc_id", "doc", "th", words_of(F.col("text")).alias("w"), "candidates")
    cut = "transform(candidates, c -> struct(c.item AS item, c.diagonal AS diagonal, slice(w, greatest(c.diagonal, 0) + 1, c.n + least(c.diagonal, 0)) AS w))"
    found = common.stored(split.select("doc_id", "doc", "th", F.size("w").cast("long").alias("n_words"), F.expr(cut).alias("parts")), "parts")
    common.discard(counts, places, anchors, index)
    part = found.where("parts IS NOT NULL").dropDuplicates(["doc", "th"]).select("doc", "th", F.explode("parts").alias("p")).select("doc", "th", "p.*")
    same = part.join(if_small(items), "item").select("doc", "th", "item_id", "diagonal", "len", F.expr("transform(iw, (x, i) -> coalesce(get(w, i + least(diagonal, 0)) = x, false))").alias("same"))
    hits = same.select("doc", "th", "item_id", "len", F.explode(F.expr("filter(sequence(0, size(same) - len), t -> forall(slice(same, t + 1, len), x -> x))")).alias("t"), "diagonal")
    return found.select("doc_id", "doc", "th", "n_words"), hits.select("doc", "th", "item_id", (F.col("t") + F.col("diagonal")).alias("start"), "len")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = 2, with_hash: bool = False) -> DataFrame:
    """How much of each document stands in the benchmark.

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. Returns for
    each document doc_id, n_words, n_hit (words inside any occurrence of a window), n_items (item_ids with occurring
    windows), items_sha256 (lowercase hex of those item_ids, sorted as strings and comma-joined), contaminated
    (n_items >= min_items), and, if with_hash, text_hash (xxhash64 of the text), which tells rows apart that repeat a doc_id.

    Every window's two rarest words by corpus count have their postings stored; postings are shifted by the word's
    place in the item and intersected on (document, item, diagonal); what remains is compared word by word with
    the document. Common words outside the benchmark's rarest are never shuffled.

    A null or empty text has no words and no hits. Rows that are repeated are reported each; rows that repeat a doc_id
    with another text are documents of their own. Items without words or with a null item_id match nothing; items that
    repeat an item_id count once. Other columns are ignored; an empty benchmark gives no hits."""
    all_docs, hits = find_windows(docs, benchmark, window)
    by_doc = hits.groupBy("doc", "th").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end"))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    covered = "aggregate(array_sort(spans), named_struct('n', 0L, 'end', 0), (a, s) -> named_struct('n', a.n + greatest(0, s.end - greatest(s.start, a.end)), 'end', greatest(a.end, s.end)), a -> a.n)"
    by_doc = by_doc.select("doc", "th", F.expr(covered).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("items"))
    out = all_docs.join(by_doc, ["doc", "th"], "left")
    n_items = F.coalesce("n_items", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), n_items.alias("n_items"), F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"), (n_items >= min_items).alias("contaminated"), *[F.col("th").alias("text_hash")] * with_hash)


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact phrase matches: doc_id, item_id, start (word position), len, a row for each occurrence of a window."""
    all_docs, hits = find_windows(docs, benchmark, window)
    return all_docs.select("doc_id", "doc", "th").join(hits, ["doc", "th"]).select("doc_id", "item_id", "start", "len")


def proximity_matches(docs: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """Places where two terms (pairs: a, b) stand at most `within` words apart: doc_id, a, b, pos_a, pos_b.

    Postings of both are joined on the document and a bucket of positions as wide as the distance."""
    keyed = common.doc_keys(docs)
    pairs = pairs.select("a", "b").distinct()
    index = common.stored(postings(keyed, pairs.select(F.explode(F.array("a", "b")).alias("term"))), "postings")
    left = index.join(if_small(pairs), F.col("term") == F.col("a")).select("doc", "th", "a", "b", F.col("pos").alias("pos_a"), F.expr(f"pos div {within}").alias("bucket"))
    right = index.select("doc", "th", F.col("term").alias("b"), F.col("pos").alias("pos_b"), F.explode(F.expr(f"sequence(pos div {within} - 1, pos div {within} + 1)")).alias("bucket"))
    met = left.join(right, ["doc", "th", "b", "bucket"]).where((F.abs(F.col("pos_a") - F.col("pos_b")) <= within) & (F.col("pos_a") != F.col("pos_b")))
    return met.select(F.when(F.col("doc") != common.NULL_ID, F.col("doc")).alias("doc_id"), "a", "b", "pos_a", "pos_b")
