"""Near duplicates by MinHash bands, verified by odd sketches and then on full shingle sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, hashing
from .hashing import U

#: MinHash values in a band; MinHash samples folded into an odd sketch, one from each bin of one permutation; its longs.
BAND_ROWS = 5
SAMPLES = 1024
SKETCH_LONGS = 32
#: Sets of so many shingles at most have a second sketch in which every shingle is a sample of its own.
WHOLE = 1500
#: Chance that a pair at the threshold shares no band.
MISS = 1e-6
#: Standard errors below the threshold at which a sketch's estimate rules a pair out.
SLACK = 4.5
#: Rounds in which the members of a bucket meet its best linked member, before all that is left apart meets.
STARS = 2
_RNG = np.random.default_rng(99)
_WORD = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | U(1)
SIGNATURE = "doc long, th long, doc_id long, n_shingles long, same binary, bands array<long>, sketch array<long>, samples int, whole array<long>"


def bands_for(threshold: float, rows: int = BAND_ROWS) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**rows))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    lengths = [len(t) + 1 for t in texts]
    data = np.frombuffer(common.lower_bytes(b" ".join(texts) + b" "), dtype=np.uint8)
    starts, ends = common.word_bounds(data, common.SPACES)
    h = hashing.Prefix(hashing.BYTE_VALUES[data]).of(starts, ends)
    cuts = np.searchsorted(starts, np.cumsum(lengths))
    out, a = [], 0
    for b in cuts:
        w = h[a:b]
        a = b
        if not len(w):
            out.append(np.zeros(0, dtype=np.uint64))
        elif len(w) < words:
            s = np.zeros(1, dtype=np.uint64) + U(len(w))
            for i, x in enumerate(w):
                s = hashing.mixed(s * _WORD[0] + x + U(i))
            out.append(s)
        else:
            n = len(w) - words + 1
            s = np.zeros(n, dtype=np.uint64)
            for i in range(words):
                s += w[i : i + n] * _WORD[1 + i % 63]
            out.append(np.unique(hashing.mixed(s)))
    return out


class Hasher:
    """Band keys of the MinHash values of shingle sets."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(3)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.c = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """The keys of sets that are not empty."""
        x = np.concatenate(sets)
        x = (x >> U(32)).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
        low = np.empty((len(self.a), len(sets)), dtype=np.uint64)
        buffer = np.empty_like(x)
        for i, (a, c) in enumerate(zip(self.a, self.c, strict=True)):
            np.bitwise_xor(x, c, out=buffer)
            np.multiply(buffer, a, out=buffer)
            low[i] = np.minimum.reduceat(buffer, starts)
        keys = np.zeros((self.bands, len(sets)), dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64)[:, None]
        for j in range(self.rows):
            keys = hashing.mixed(keys * _WORD[1] + low.reshape(self.bands, self.rows, -1)[:, j])
        return keys.T.astype(np.uint64).view(np.int64)


def odd_sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """The odd sketch of each set, how many samples it folds, and a sketch of all shingles for sets of WHOLE at most.

    One permutation gives a MinHash sample in each of SAMPLES bins that is not empty. Each sample flips one bit, so
    samples that two sets have in common cancel in the exclusive or of their sketches."""
    bits = 64 * SKETCH_LONGS
    flips = np.zeros((len(sets), bits), dtype=bool)
    every = np.zeros((len(sets), bits), dtype=bool)
    count = np.zeros(len(sets), dtype=np.int32)
    for i, s in enumerate(sets):
        bins = s >> U(64 - SAMPLES.bit_length() + 1)
        bit = (hashing.mixed(s * _WORD[2]) % U(bits)).astype(np.int64)
        least = np.concatenate(([True], bins[1:] != bins[:-1])) if len(s) else np.zeros(0, dtype=bool)
        flips[i] = np.bincount(bit[least], minlength=bits) & 1
        count[i] = least.sum()
        if len(s) <= WHOLE:
            every[i] = np.bincount(bit, minlength=bits) & 1
    whole = np.packbits(every, axis=1).view("<i8")
    return np.packbits(flips, axis=1).view("<i8"), count, [w if len(s) <= WHOLE else None for w, s in zip(whole, sets, strict=True)]


def may_be_similar(a: str, b: str, threshold: float) -> Column:
    """False where set sizes or sketches rule out a similarity of threshold; a and b prefix n, sketch, samples and whole.

    With t bits flipped apart, m = (samples_a + samples_b - t) / 2 samples agree. Where both sets have a sketch of all
    their shingles, m estimates the intersection itself, which at the threshold is threshold / (1 + threshold) of both
    sizes; m varies only with flips of one bit that cancel out. Else, the union at the threshold has
    u = (n_a + n_b) / (1 + threshold) shingles, which fill about SAMPLES * (1 - exp(-u / SAMPLES)) bins, and the
    threshold's share of these agree; m also varies with the sampling and with the number of bins that are filled. m must
    lie SLACK standard errors below that to rule a pair out."""
    bits = 64.0 * SKETCH_LONGS

    def apart(name: str) -> Column:
        return sum((F.bit_count(F.col(f"{a}{name}")[i].bitwiseXOR(F.col(f"{b}{name}")[i])) for i in range(SKETCH_LONGS)), F.lit(0))

    def most(samples: Column, least: Column, variance: Column | float) -> Column:
        """The most bits apart at which m >= least - SLACK * sqrt(variance + t * t / (2 * bits) + 0.25); the last two count
        bits that were flipped more than once. t = -bits / 2 * log(1 - 2 * apart / bits), and m falls with it."""
        room, g = samples / 2 - least, 2 * SLACK**2 / bits
        past = (g * room + F.sqrt(g * g * room * room + (1 - g) * (SLACK**2 * (variance + 0.25) + g * room * room))) / (1 - g)
        return bits / 2 * (1 - F.exp(-4 * (room + past) / bits))

    both = F.col(f"{a}n") + F.col(f"{b}n")
    union = both / (1 + threshold)
    empty = F.exp(-union / SAMPLES)
    filled = SAMPLES * (1 - empty)
    spread = threshold**2 * SAMPLES * empty * (1 - (1 + union / SAMPLES) * empty)
    chance = filled * threshold * (1 - threshold) * (1 - filled / union)  # a small set is sampled almost whole
    binned = apart("sketch") <= most(F.col(f"{a}samples") + F.col(f"{b}samples"), threshold * filled, chance + spread)
    exact = apart("whole") <= most(both, threshold / (1 + threshold) * both, 0.0)
    sizes = F.least(f"{a}n", f"{b}n") >= threshold * F.greatest(f"{a}n", f"{b}n") - 1e-6
    return sizes & F.when(F.col(f"{a}whole").isNotNull() & F.col(f"{b}whole").isNotNull(), exact).otherwise(binned)


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """A row for each document, SIGNATURE: set size, sha256 of the sorted set, band keys and sketches."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(bands, rows)
        for batch in common.pieces(batches, 64):
            sets = shingle_sets(common.texts_of(batch), words)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [[]] * len(sets)
            if full:
                for i, k in zip(full, hasher([sets[i] for i in full]), strict=True):
                    keys[i] = k
            sketch, samples, whole = odd_sketches(sets)
            same = [hashlib.sha256(s).digest() for s in sets]
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array([len(s) for s in sets], pa.int64()), pa.array(same, pa.binary()), pa.array(keys, lists), pa.array(list(sketch), lists), pa.array(samples), pa.array(whole, lists)],
                names=["doc", "th", "doc_id", "n_shingles", "same", "bands", "sketch", "samples", "whole"],
            )

    return common.doc_keys(docs).select("doc", "th", "doc_id", "text").mapInArrow(sign, SIGNATURE)


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The whole shingle sets (doc, body) of the documents in `wanted` (doc, th), stored."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, 64):
            found = shingle_sets(common.texts_of(batch), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc", "body"])

    chosen = common.doc_keys(docs).join(wanted, ["doc", "th"], "left_semi").dropDuplicates(["doc", "th"])
    return common.stored(chosen.select("doc", "text").mapInArrow(sets, "doc long, body binary"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, 256):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = np.concatenate((s, t))
                both.sort()
                common_ = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common_ >= percent * (len(both) - common_))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("doc").alias("a"), F.col("body").alias("body_a"))
    two = sets.select(F.col("doc").alias("b"), F.col("body").alias("body_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "body_a", "body_b").mapInArrow(confirm, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node reachable) of every node in links (a, b). The least label spreads and labels are
    replaced by their own label each round; a round's labels are stored, so that lineage stays short."""
    edges = common.stored(links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).distinct(), "edges")
    labels = common.stored(edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = spread.join(labels.select(F.col("node").alias("mid"), F.col("label").alias("far")), "mid").select("node", F.least("mid", "far").alias("label"), (F.least("mid", "far") < F.col("old")).alias("moved"))
        now = common.stored(jump, "labels")
        common.discard(labels)
        labels = now
        if not now.where("moved").limit(1).count():
            common.discard(edges)
            out = labels.select("node", "label")
            out.stored_at = labels.stored_at
            return out


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents whose sets of word shingles have 100 * intersection size >= percent * union size.

    Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased. Returns for each document doc_id, n_shingles (size
    of its set), component_id (the least doc_id that links lead to), kept (doc_id = component_id).

    Documents with equal sets (by the sha256 of the sorted shingles) are one class from the start and only its least
    doc_id goes on. Classes that share a MinHash band meet the least of their bucket; what the odd sketches do not rule
    out is confirmed on full sets, 64 bits a shingle. In buckets that still hold several components, members outside the
    component of the best linked member meet that one, in STARS rounds: pairs in proportion to the bucket. Then members
    outside a bucket's largest component meet all others of another component, by sketch and full sets. So links between
    different texts are found wherever bands meet, while a bucket of copies costs as many pairs as it has members; only
    texts that are near a large component but linked to none of it cost a comparison of sketches with each of its
    members. Pairs at the threshold share no band with a chance of MISS.

    A document without words has an empty set, is linked with nothing and is its own component; with fewer words
    than a shingle, its words are its only shingle. Rows that repeat a doc_id are one node of the graph and are each
    reported; a null doc_id is one node that sorts first, its ids reported null. An empty table gives no rows. Other
    columns are ignored."""
    threshold = percent / 100
    parts = ("doc", "n", "sketch", "samples", "whole")
    signed = common.stored(signatures(docs, words, bands_for(threshold), BAND_ROWS), "signatures")
    sizes = signed.select("doc", "th", "doc_id", F.col("n_shingles").alias("n"), "same")
    # classes of several rows are stored first: a join of two plain shuffles can split a class with very many copies
    classes = common.stored(sizes.where("n > 0").groupBy("same").agg(F.min("doc").alias("rep"), F.max("doc").alias("last")).where("rep < last").select("same", "rep"), "classes")
    member = common.stored(sizes.join(classes, "same", "left").select("doc", "th", "doc_id", "n", F.coalesce("rep", "doc").alias("rep")), "members")
    first = member.where("n > 0 AND doc = rep").select("doc", "th")
    heads = signed.where("n_shingles > 0").join(first, ["doc", "th"], "left_semi").dropDuplicates(["doc", "th"])
    buckets = heads.select("doc", "th", F.posexplode("bands").alias("band", "key"))
    shared = buckets.groupBy("key").agg(F.min("doc").alias("head"), F.max("doc").alias("last")).where("head < last").select("key", "head")
    shared = common.stored(shared, "shared")
    met = common.stored(buckets.join(shared, "key").select("key", "band", "doc", "th", "head"), "buckets")
    wanted = met.select("doc", "th").distinct()
    sketches = common.stored(signed.join(wanted, ["doc", "th"], "left_semi").dropDuplicates(["doc", "th"]).select("doc", "th", F.col("n_shingles").alias("n"), "sketch", "samples", "whole", "bands"), "sketches")
    common.discard(signed, shared, classes)
    sets = full_sets(docs, wanted, words)
    side = lambda p: sketches.select(*[F.col(c).alias(f"{p}{c}") for c in parts])
    used = [met, sketches, sets]

    def linked(pairs: DataFrame) -> DataFrame:
        likely = pairs.join(side("a_"), F.col("a") == F.col("a_doc")).join(side("b_"), F.col("b") == F.col("b_doc")).where(may_be_similar("a_", "b_", threshold))
        return common.stored(confirmed(likely.select("a", "b").distinct(), sets, percent), "links")

    def label_buckets(links: DataFrame) -> DataFrame:
        """key, band, doc, th, label of the members of buckets that still hold more than one component."""
        label = components(links)
        used.append(label)
        named = common.stored(met.join(label.withColumnRenamed("node", "doc"), "doc", "left").select("key", "band", "doc", "th", F.coalesce("label", "doc").alias("label")), "named")
        mixed = common.stored(named.groupBy("key").agg(F.min("label").alias("one"), F.max("label").alias("two")).where("one < two").select("key"), "mixed")
        out = common.stored(named.join(mixed, "key"), "open")
        common.discard(named, mixed)
        used.append(out)
        return out

    # stars: the members of a bucket meet its least one; then those outside the component of a bucket's best linked member meet that
    tried = common.stored(met.where("doc > head").select(F.col("head").alias("a"), F.col("doc").alias("b")).distinct(), "tried")
    links = linked(tried)
    again = member.groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.collect_set("rep").alias("reps")).where("a < b")
    links = links.union(again.select("a", F.explode("reps").alias("b")).where("a < b"))
    for _ in range(STARS):
        rows = label_buckets(links)
        degree = links.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count(F.lit(1)).alias("degree"))
        # a member that met others as the least of a bucket has all it will get from that, so it is not chosen anew
        degree = degree.join(met.select(F.col("head").alias("doc")).distinct(), "doc", "left_anti")
        hub = common.stored(rows.join(degree, "doc").groupBy("key").agg(F.max_by(F.struct("doc", "label"), F.struct("degree", -F.col("doc"))).alias("hub")), "hubs")
        used.append(hub)
        pairs = rows.join(hub, "key").where("label <> hub.label").select(F.least("doc", "hub.doc").alias("a"), F.greatest("doc", "hub.doc").alias("b")).distinct()
        pairs = common.stored(pairs.join(tried, ["a", "b"], "left_anti"), "tried")
        links, tried = links.union(linked(pairs)), tried.union(pairs)
    # what the stars left apart: members outside the largest component of their bucket meet all of other components
    rows = label_buckets(links)
    counted = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    most = common.stored(counted.groupBy("key").agg(F.max_by("label", F.struct("c", -F.col("label"))).alias("most")), "most")
    rows = common.stored(rows.join(most, "key").join(sketches, ["doc", "th"]), "rows")
    pick = lambda d, p: d.select(*[F.col(c).alias(f"{p}{c}") for c in ("key", "band", "label", "most", "bands", *parts)])
    x, y = pick(rows.where("label <> most"), "a_"), pick(rows, "b_").withColumn("b_stray", F.col("b_label") != F.col("b_most"))
    apart = (F.col("a_key") == F.col("b_key")) & (F.col("a_label") != F.col("b_label")) & (~F.col("b_stray") | (F.col("a_doc") < F.col("b_doc")))
    # a pair is looked at in the first band it shares
    for j in range(bands_for(threshold) - 1):
        first_band = (F.col("a_band") <= j) | (F.col("a_bands")[j] != F.col("b_bands")[j])
        apart_first = first_band if j == 0 else apart_first & first_band
    more = x.join(y, apart & apart_first & may_be_similar("a_", "b_", threshold)).select(F.least("a_doc", "b_doc").alias("a"), F.greatest("a_doc", "b_doc").alias("b")).distinct()
    later = common.stored(confirmed(more.join(tried, ["a", "b"], "left_anti"), sets, percent), "links")
    label = components(links.union(later))
    common.discard(*used, rows, most)
    out = member.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("doc", "doc_id", "n", F.coalesce("label", "rep").alias("c"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("c") != common.NULL_ID, F.col("c")).alias("component_id"), (F.col("doc") == F.col("c")).alias("kept"))
