"""Finding windows that occur more than once, over documents as sequences of hashed symbols.

Window starts that share a minimizer anchor form a zone. Equal windows have equal anchors at equal offsets, so:

1. Zones are counted by their anchor's gram. A zone whose gram stands nowhere else has no repeated window.
2. Zones of repeated grams are sent with their bytes to the task of their gram (the prefix that their suffixes run
   through). There, zones that are equal byte for byte are one, and the operator's own structure compares the suffixes of
   those that differ.
3. Of more than PROVEN zones that agree in two unlike 64-bit hashes of the whole, one of their symbols and one of their
   bytes, beside that of the gram, only one is sent, and all repeat all their windows: a passage with very many copies
   costs no task more than one of them.
4. A gram with more than HOT zones to be sent is split by longer prefixes instead: by what all windows of a strip have in
   common, and then by whole windows, as hashes of two bases, counted before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashing

#: Zones of one gram up to which they meet in one task; equal zones up to which each is sent and compared by its bytes.
HOT = 512
PROVEN = 16
#: Windows of a strip, in which hot zones are compared at first.
STRIP = 8
#: Symbols taken at a time; a longer document is cut into chunks that overlap by a window.
CHUNK = 1 << 17
#: Bytes of zones that are compared at a time; more only if they are of one gram.
COMPARED = 1 << 19
#: What becomes of a zone: all its windows are repeated; still open; stands for equal ones; and the latter two where the gram is hot.
REPEATED, OPEN, STANDS, OPEN_HOT, STANDS_HOT = range(5)

#: Hashes of the symbols of texts; and the bytes of one text's symbols with, where a symbol is not a byte, the place of each.
Reader = Callable[[list[bytes]], list[np.ndarray]]
Plain = Callable[[bytes], tuple[bytes, np.ndarray | None]]


def document_zones(values: list[np.ndarray], window: int, gram: int) -> Iterator[tuple[int, int, hashing.Prefix, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document's number, offset of its symbol 0, prefix hashes, lo, hi, anchor, gram hash) of stretches of documents;
    lo, hi and anchor are places in the prefix hashes."""
    i = 0
    while i < len(values):
        if len(values[i]) > CHUNK:
            for at in range(0, len(values[i]) - window + 1, CHUNK):
                part = values[i][at : at + CHUNK + window - 1]
                prefix, lo, hi, anchor, k = hashing.zones(part, np.full(len(part), len(part)), window, gram)
                yield i, -at, prefix, lo, hi, anchor, k
            i += 1
            continue
        some, size = [], 0
        while i + len(some) < len(values) and size + len(values[i + len(some)]) <= CHUNK:
            some.append(values[i + len(some)])
            size += len(some[-1])
        ends = np.cumsum([len(v) for v in some])
        prefix, lo, hi, anchor, k = hashing.zones(np.concatenate(some), np.repeat(ends, [len(v) for v in some]), window, gram)
        cuts = np.searchsorted(lo, ends)
        a = 0
        for j, b in enumerate(cuts):
            if b > a:
                yield i + j, int(ends[j] - len(some[j])), prefix, lo[a:b], hi[a:b], anchor[a:b], k[a:b]
            a = b
        i += len(some)


def byte_ranges(places: np.ndarray | None, lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where symbols [lo, end) begin and end in the bytes; one byte stands between symbols that are not bytes."""
    return (lo, end) if places is None else (places[lo], places[end] - 1)


def zone_rows(keyed: DataFrame, read: Reader, plain: Plain, window: int, gram: int) -> DataFrame:
    """k (gram hash), u and v (hashes of the whole zone, of its symbols and of its bytes), doc, th and lo of every zone."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            doc, th = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cols: list[list] = [[], [], [], [], [], []]
            texts = common.texts_of(batch)
            last, data, places = -1, b"", None
            for i, base, prefix, lo, hi, _, k in document_zones(read(texts), window, gram):
                if i != last:
                    last, (data, places) = i, plain(texts[i])
                starts, ends = byte_ranges(places, lo - base, hi + window - base)
                v = np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.uint64)
                for c, x in zip(cols, (k.view(np.int64), prefix.of(lo, hi + window).view(np.int64), v.view(np.int64), np.full(len(lo), doc[i]), np.full(len(lo), th[i]), lo - base), strict=True):
                    c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["k", "u", "v", "doc", "th", "lo"])

    return keyed.select("doc", "th", "text").mapInArrow(rows, "k long, u long, v long, doc long, th long, lo long")


def decide(zones: DataFrame, earlier: bool) -> tuple[DataFrame, bool, list[DataFrame]]:
    """doc, th, los, kinds: what is known of the zones of each document that has any; whether a gram is hot; and the
    stored tables that this is read from.

    earlier: a window is repeated if it occurs in a document with a smaller id; else, if it occurs anywhere else."""
    grams = zones.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"), F.min("doc").alias("d0"), F.max("doc").alias("d1"))
    same = (F.col("u0") == F.col("u1")) & (F.col("v0") == F.col("v1"))
    grams = grams.where("d0 < d1" if earlier else "c > 1").select("k", same.alias("same"), (F.col("c") > PROVEN).alias("many"), "d0")
    grams = common.stored(grams, "grams")  # so that the join below can deal a hot gram to many tasks
    met = common.stored(zones.join(grams, "k"), "zones")
    common.discard(grams)
    alone = F.when(F.col("doc") > F.col("d0"), OPEN).otherwise(STANDS) if earlier else F.lit(OPEN)
    equal = met.where("same AND (NOT many OR doc > d0)" if earlier else "same").select("doc", "th", "lo", F.when(F.col("many"), REPEATED).otherwise(alone).cast("int").alias("kind"))
    mixed = met.where("NOT same").select("k", "u", "v", "doc", "th", "lo", "d0")
    first = F.struct("doc", "th", "lo")
    whole = mixed.groupBy("k", "u", "v").agg(F.count(F.lit(1)).alias("c"), F.min(first).alias("first")).where(f"c > {PROVEN}")
    whole = common.stored(whole, "whole")
    copied = F.col("c").isNotNull() & (F.col("doc") > F.col("first.doc") if earlier else F.lit(True))
    mixed = mixed.join(whole, ["k", "u", "v"], "left").select("k", "doc", "th", "lo", F.when(copied, REPEATED).otherwise(alone).cast("int").alias("kind"), F.coalesce(F.struct("doc", "th", "lo") == F.col("first"), F.lit(False)).alias("is_first"))
    mixed = common.stored(mixed, "mixed")
    common.discard(whole)
    sent = mixed.where(f"kind <> {REPEATED}" + ("" if earlier else " OR is_first")).select("k", "doc", "th", "lo", F.when(F.col("kind") == REPEATED, STANDS).otherwise(F.col("kind")).alias("kind"))
    sent = sent.distinct()
    hot = common.stored(sent.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT).select("k", F.lit(2).alias("more")), "hot")
    sent = sent.join(hot, "k", "left").select("doc", "th", "lo", (F.col("kind") + F.coalesce("more", F.lit(0))).cast("int").alias("kind"))
    known = equal.union(mixed.where(f"kind = {REPEATED}").select("doc", "th", "lo", "kind")).union(sent)
    by_doc = known.groupBy("doc", "th").agg(F.collect_set(F.struct("lo", "kind")).alias("z")).select("doc", "th", F.col("z.lo").alias("los"), F.col("z.kind").alias("kinds"))
    return by_doc, hot.limit(1).count() > 0, [met, mixed, hot]


def equal_zones(key: np.ndarray, head: np.ndarray, size: np.ndarray, start: np.ndarray, data: np.ndarray, prefix: hashing.Prefix) -> np.ndarray:
    """A number for each different zone of a key: zones at data[start : start + size] that are equal and have their anchor at
    one place. Found by hashes, confirmed symbol by symbol."""
    u = prefix.of(start, start + size)
    order = np.lexsort((u, size, head, key))
    new = np.concatenate(([True], np.diff(key[order]) != 0)) | np.concatenate(([True], (np.diff(head[order]) != 0) | (np.diff(size[order]) != 0) | (u[order][1:] != u[order][:-1])))
    number = np.empty(len(key), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    first = order[new]
    wrong: set[int] = set()
    others = np.flatnonzero(first[number] != np.arange(len(key)))
    for at in range(0, len(others), 10_000):
        i = others[at : at + 10_000]
        n = size[i]
        reach = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        equal = data[np.repeat(start[i], n) + reach] == data[np.repeat(start[first[number[i]]], n) + reach]
        if not equal.all():
            wrong.update(number[i[np.unique(np.repeat(np.arange(len(i)), n)[~equal])]].tolist())
    for g in wrong:  # different zones with one hash
        parts: dict[bytes, int] = {}
        for i in np.flatnonzero(number == g):
            number[i] = parts.setdefault(data[start[i] : start[i] + size[i]].tobytes(), number.max() + 1)
    return np.unique(number, return_inverse=True)[1]


def by_zones(key: np.ndarray, doc: np.ndarray, zone: np.ndarray, earlier: bool, windows: Callable[[np.ndarray], list[np.ndarray]]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Which zones repeat all their windows because they are equal to others, and masks of the windows of those that may
    repeat some. zone: numbers of equal_zones; windows(zones) compares the windows of zones that differ."""
    order = np.lexsort((doc, zone))
    rep = order[np.concatenate(([True], np.diff(zone[order]) != 0))]  # of each, that of the least document
    whole = doc > doc[rep][zone] if earlier else np.bincount(zone)[zone] > 1
    by_key = np.argsort(key[rep], kind="stable")
    same = np.diff(key[rep][by_key]) == 0
    contested = rep[by_key][np.concatenate(([False], same)) | np.concatenate((same, [False]))]
    masks = dict(zip(contested.tolist(), windows(contested), strict=True)) if len(contested) else {}
    found = {i: masks[r] for i, r in enumerate(rep[zone].tolist()) if r in masks and not whole[i]} if masks else {}
    return whole, found


def hot_spans(strips: DataFrame, earlier: bool) -> DataFrame:
    """doc, th, s, e of the repeated window starts of open strips, runs of STRIP windows of a hot gram.

    A strip that occurs again as a whole is repeated as a whole; only of the others, and of one of each such set, the
    windows are looked at one by one, and only if what all windows of the strip have in common occurs again."""
    whole = common.stored(strips.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc", "th", "s")).alias("first")).where("c > 1"), "whole")
    known = common.stored(strips.join(whole, ["h1", "h2"], "left"), "known")
    again = "c > 1 AND doc > first.doc" if earlier else "c > 1"
    left = "c IS NULL OR doc = first.doc" if earlier else "c IS NULL OR (doc = first.doc AND th = first.th AND s = first.s)"
    cores = strips.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("d0"), F.max("doc").alias("d1")).where("d0 < d1" if earlier else "n > 1")
    left = known.where(left).join(common.stored(cores.select("core"), "cores"), "core", "left_semi")
    windows = left.select("doc", "th", "s", (F.col("open") & (F.lit(True) if earlier else F.col("c").isNull())).alias("open"), F.posexplode(F.arrays_zip("w1", "w2")).alias("i", "w"))
    windows = windows.select("doc", "th", (F.col("s") + F.col("i")).alias("s"), "open", "w.w1", "w.w2")
    counted = common.stored(windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c"), F.min("doc").alias("d0")).where("c > 1"), "counted")
    single = windows.where("open").join(counted, ["w1", "w2"])
    single = (single.where("doc > d0") if earlier else single).select("doc", "th", "s", F.col("s").alias("e"))
    return known.where("open").where(again).select("doc", "th", "s", "e").union(single)


def spans_of(starts: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join intervals [start, last] of window starts that touch or overlap."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(last[order]) if len(last) else last
    new = np.concatenate(([True], s[1:] > e[:-1] + 1)) if len(s) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(new)
    return s[at], e[np.append(at[1:], len(s)) - 1] if len(s) else e


def covered(starts: np.ndarray, last: np.ndarray, window: int, n: int) -> tuple[np.ndarray, int]:
    """Mask of the symbols inside windows that start in [start, last], and the number of its runs."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, last + window, -1)
    mask = np.cumsum(edge[:-1]) > 0
    return mask, int((mask & ~np.concatenate(([False], mask[:-1]))).sum()) if n else 0


def mark_repeats(docs: DataFrame, read: Reader, plain: Plain, window: int, gram: int, earlier: bool, match: Callable, finish: Callable[[bytes, np.ndarray, np.ndarray], tuple], result: pa.Schema, result_ddl: str, with_hash: bool = False) -> DataFrame:
    """For every document, doc_id and finish(text, starts, last) for the intervals of repeated window starts; if with_hash,
    text_hash too, the text's xxhash64.

    match(keys, docs, bodies, heads, window, earlier) compares the suffixes of zones, given as bytes, and returns the number of
    windows of each, which repeat all of them, and masks of others."""
    keyed = common.doc_keys(docs)
    flags, any_hot, used = decide(zone_rows(keyed, read, plain, window, gram), earlier)
    names = result.names
    strip = max(1, min(STRIP, window // 2))
    base = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("doc_id", pa.int64()), ("text", pa.binary()), ("waits", pa.bool_()), ("sends", pa.bool_()), ("los", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int32())), ("s", pa.list_(pa.int64())), ("e", pa.list_(pa.int64())), *result])
    ddl = f"doc long, th long, doc_id long, text binary, waits boolean, sends boolean, los array<long>, kinds array<int>, s array<long>, e array<long>, {result_ddl}"

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            texts = common.texts_of(batch)
            los, kinds = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            with_flags = [i for i, x in enumerate(los) if x]
            intervals = {i: ([], []) for i in with_flags}
            for j, at, _, lo, hi, _, _ in document_zones(read([texts[i] for i in with_flags]), window, gram):
                i = with_flags[j]
                done = np.array([x for x, kind in zip(los[i], kinds[i], strict=True) if kind == REPEATED], dtype=np.int64)
                take = np.isin(lo - at, done)
                intervals[i][0].append(lo[take] - at)
                intervals[i][1].append(hi[take] - at)
            rows = []
            for i, (doc, th, doc_id) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                none = np.zeros(0, dtype=np.int64)
                s, e = spans_of(*(np.concatenate(x) for x in intervals[i])) if i in intervals and intervals[i][0] else (none, none)
                k = kinds[i] or []
                waits, sends = OPEN in k or OPEN_HOT in k, any(x != REPEATED for x in k)
                left = [(x, y) for x, y in zip(los[i] or [], k, strict=True) if y != REPEATED]
                row = {"doc": doc, "th": th, "doc_id": doc_id, "text": texts[i] if sends else None, "waits": waits, "sends": sends}
                row |= {"los": [x for x, _ in left], "kinds": [y for _, y in left], "s": s.tolist() if waits else None, "e": e.tolist() if waits else None}
                rows.append(row | dict(zip(names, [None] * len(names) if waits else finish(texts[i], s, e), strict=True)))
            yield pa.RecordBatch.from_pylist(rows, schema=base)

    joined = keyed.join(flags, ["doc", "th"], "left").select("doc", "th", "doc_id", "text", "los", "kinds")
    table = common.stored(joined.mapInArrow(first_pass, ddl), "documents")
    common.discard(*used)

    def open_zones(batch: pa.RecordBatch, wanted: tuple[int, int]) -> Iterator[tuple]:
        """(row, kinds, prefix, lo, hi, anchor, gram hash, offset) of the zones of the wanted kinds in a stretch of a row."""
        texts = batch.column(2).to_pylist()
        lists = [batch.column(c) for c in (3, 4)]
        cuts = np.asarray(lists[0].offsets)
        los, kinds = (np.asarray(x.values) for x in lists)
        rows = [i for i in range(len(texts)) if np.isin(kinds[cuts[i] : cuts[i + 1]], wanted).any()]
        for j, at, prefix, lo, hi, anchor, k in document_zones(read([texts[i] for i in rows]), window, gram):
            own = slice(cuts[rows[j]], cuts[rows[j] + 1])
            order = np.argsort(los[own])
            known, kind = los[own][order], kinds[own][order]
            place = np.minimum(np.searchsorted(known, lo - at), len(known) - 1)
            take = np.flatnonzero((known[place] == lo - at) & np.isin(kind[place], wanted))
            if len(take):
                yield rows[j], kind[place[take]], prefix, lo[take], hi[take], anchor[take], k[take], at

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, 64):
            doc, th = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            last, data, places = -1, b"", None
            out: list[list] = [[] for _ in range(6)]
            bodies: list[bytes] = []
            for i, kind, _, lo, hi, anchor, k, at in open_zones(batch, (OPEN, STANDS)):
                if i != last:
                    last, (data, places) = i, plain(batch.column(2)[i].as_py())
                starts, ends = byte_ranges(places, lo - at, hi - at + window)
                bodies += [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                for c, x in zip(out, (k.view(np.int64), np.full(len(lo), doc[i]), np.full(len(lo), th[i]), lo - at, (anchor - lo).astype(np.int32), kind == OPEN), strict=True):
                    c.append(x)
            if bodies:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in out), pa.array(bodies, pa.binary())], names=["key", "doc", "th", "lo", "head", "open", "body"])

    def send_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, 64):
            doc, th = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            texts = batch.column(2).to_pylist()
            second: dict[int, np.ndarray] = {}
            out: list[list] = [[] for _ in range(10)]
            hot_zones = ((i, kinds[z], prefix, int(lo[z]), int(hi[z]), int(anchor[z]), at) for i, kinds, prefix, lo, hi, anchor, _, at in open_zones(batch, (OPEN_HOT, STANDS_HOT)) for z in range(len(lo)))
            for i, kind, prefix, lo, hi, anchor, at in hot_zones:
                if i not in second:
                    second = {i: hashing.Prefix(read([texts[i]])[0], hashing.SECOND_BASE, hashing.SECOND_INVERSE)}
                s = np.arange(lo, hi + 1)
                block = (anchor - s) // strip  # counted from the anchor, so that equal stretches are cut alike
                first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
                a, b = s[first], s[np.append(first[1:], len(s)) - 1]
                n = len(first)
                w1, w2 = prefix.of(s, s + window).view(np.int64), second[i].of(s - at, s - at + window).view(np.int64)
                row = (prefix.of(a, b + window).view(np.int64), second[i].of(a - at, b - at + window).view(np.int64), np.full(n, doc[i]), np.full(n, th[i]), a - at, b - at, np.full(n, kind == OPEN_HOT))
                core = anchor - block[first] * strip  # from here, for window - strip + 1 symbols, all windows of the strip agree
                row = (*row, prefix.of(core, core + window - strip + 1).view(np.int64))
                for c, x in zip(out, (*row, np.split(w1, first[1:]), np.split(w2, first[1:])), strict=True):
                    c.append(x)
            if out[0]:
                lists = [pa.array([x for c in out[k] for x in c], pa.list_(pa.int64())) for k in (8, 9)]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in out[:8]), *lists], names=["h1", "h2", "doc", "th", "s", "e", "open", "core", "w1", "w2"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            body = t.column("body").to_pylist()
            key, doc, lo, head, is_open = (np.asarray(t.column(c)) for c in ("key", "doc", "lo", "head", "open"))
            n, whole, found = match(key, doc, body, head, window, earlier)
            at = np.flatnonzero(whole & is_open)
            s, e, row = [lo[at]], [lo[at] + n[at] - 1], [at]
            for i, m in found.items():
                if is_open[i] and m.any():
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], m.astype(np.int8), [0]))))
                    s.append(lo[i] + edge[::2])
                    e.append(lo[i] + edge[1::2] - 1)
                    row.append(np.full(len(edge) // 2, i))
            row = np.concatenate(row)
            return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(np.asarray(t.column("th"))[row]), pa.array(np.concatenate(s)), pa.array(np.concatenate(e))], names=["doc", "th", "s", "e"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in common.pieces(batches, 512):
            key = np.asarray(batch.column(0))
            # all of a key's rows are compared together, so cut only where the key changes
            cut = int(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[-1]) if not held or key[0] == held[-1].column(0)[-1].as_py() else 0
            if held and key[0] != held[-1].column(0)[-1].as_py():
                cut = int(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[-1])
            if cut:
                held.append(batch.slice(0, cut))
                size += held[-1].nbytes
            elif held and key[0] == held[-1].column(0)[-1].as_py():
                held.append(batch)
                size += batch.nbytes
                continue
            if size > COMPARED:
                yield answer(held)
                held, size = [], 0
            held.append(batch.slice(cut))
            size += held[-1].nbytes
        if held:
            yield answer(held)

    sends = table.where("sends").select("doc", "th", "text", "los", "kinds")
    zone = "key long, doc long, th long, lo long, head int, open boolean, body binary"
    found = sends.mapInArrow(send, zone).repartition("key").sortWithinPartitions("key").mapInArrow(compare, "doc long, th long, s long, e long")
    if any_hot:
        strips = common.stored(sends.mapInArrow(send_hot, "h1 long, h2 long, doc long, th long, s long, e long, open boolean, core long, w1 array<long>, w2 array<long>"), "strips")
        found = found.union(hot_spans(strips, earlier))
    spans = found.groupBy("doc", "th").agg(F.collect_list("s").alias("more_s"), F.collect_list("e").alias("more_e"))
    out = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), *result])

    def last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            rows = []
            for r in batch.to_pylist():
                s, e = (np.array([*r[a], *(r[b] or [])], dtype=np.int64) for a, b in (("s", "more_s"), ("e", "more_e")))
                rows.append({"doc_id": r["doc_id"], "th": r["th"]} | dict(zip(names, finish(r["text"], *spans_of(s, e)), strict=True)))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    waiting = table.where("waits").select("doc", "th", "doc_id", "text", "s", "e").join(spans, ["doc", "th"], "left")
    settled = table.where("NOT waits").select("doc_id", "th", *names)
    done = waiting.select("doc_id", "th", "text", "s", "e", "more_s", "more_e").mapInArrow(last_pass, f"doc_id long, th long, {result_ddl}")
    return settled.union(done).select("doc_id", *names, *[F.col("th").alias("text_hash")] * with_hash)
