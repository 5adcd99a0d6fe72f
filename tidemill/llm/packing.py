"""Best-fit packing planned on the histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("block", pa.int64()), ("place", pa.int64())])


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths.

    Sequences that hold the same lengths are one pattern with a count, so the plan's size follows the number of
    different lengths and not the number of pieces. Returns slot ranges
    (length, first rank, ranks, copies in each sequence, first sequence, offset of the first copy, pattern):
    rank first + b * copies + j of that length goes to sequence first_sequence + b, at offset + j * length."""
    free: dict[int, list] = defaultdict(list)  # room left -> [(first sequence, count, room used)]
    sequences = 0
    slots = []
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = min((r for r in free if r >= length), default=None)
            if room is None:
                each = capacity // length
                count = max(1, left // each)
                first, sequences, used = sequences, sequences + count, 0
                groups = [(first, count, used)]
                room = capacity
            else:
                groups = free.pop(room)
            while groups:
                first, count, used = groups.pop()
                if not left:
                    free[room].append((first, count, used))
                    continue
                each = room // length
                full = min(count, left // each)
                if full:
                    slots.append((length, rank, full * each, each, first, used, len(slots)))
                    free[room - each * length].append((first, full, used + each * length))
                    rank, left, first, count = rank + full * each, left - full * each, first + full, count - full
                if count and left:  # fewer than fill one more sequence
                    slots.append((length, rank, left, left, first, used, len(slots)))
                    free[room - left * length].append((first, 1, used + left * length))
                    rank, left, first, count = rank + left, 0, first + 1, count - 1
                if count:
                    free[room].append((first, count, used))
    return slots


def cut(docs: DataFrame, capacity: int, path: str, end_id: int, remembered: int) -> DataFrame:
    """The pieces of each document with their lengths, and for each its task's number and its place among the task's pieces of that length."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = tokens.encoder(path, remembered)
        end = np.array([end_id], dtype="<u4").tobytes()
        block = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in common.pieces(batches):
            rows: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for doc_id, raw in zip(ids, code.encode_all([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                raw += end
                n = len(raw) // 4
                at, piece = 0, 0
                while at < n:
                    size = (n - 1) % capacity + 1 if piece == 0 else capacity
                    rows.append((doc_id, piece, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)]), block, seen[size]))
                    seen[size] += 1
                    at, piece = at + size, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PIECES.types, strict=True)], schema=PIECES)
        if remembered < tokens.REMEMBERED:
            code.clear()
            common.give_back()

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long, block long, place long")


def pack(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = 2, remembered: int = tokens.REMEMBERED) -> DataFrame:
    """Pack every document's ids, with end_id behind them, into as few sequences of at most capacity ids as best-fit finds.

    Only documents longer than capacity are cut; the first piece takes the remainder and may be shorter.
    One row for each piece: doc_id, piece, start (its document's ids before it), length, ids_crc32 (unsigned, of the
    little-endian 32-bit ids), sequence_id, offset (gapless from 0 in each sequence).

    The histogram of lengths goes to the driver: at most `capacity` rows at any input size. Pieces find their slots by
    their rank within their length: the rank in the task that encoded them plus the earlier tasks' pieces of that
    length, so that no length, however common, meets in one task.

    A null or empty text is the one id end_id. Repeated rows are packed each for itself; a null doc_id stays null.
    An empty table gives no rows. Columns besides doc_id and text are ignored. `remembered` bounds the units whose ids a
    worker holds, and below its default they are let go at the end of a task; it changes memory and time only."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    found = common.stored(cut(docs, capacity, tokens.tokenizer_path(tokenizer), end_id, remembered), "pieces")
    by_block = common.stored(found.groupBy("block", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_block.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan(counts, capacity)
    span = np.array([(s[0] << 44) + s[1] for s in slots], dtype=np.int64)  # sorted: lengths descend, so sort anew
    table = np.array([s[:6] for s in slots], dtype=np.int64).reshape(-1, 6)
    order = np.argsort(span, kind="stable")
    span, table = span[order], table[order]
    earlier = by_block.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    earlier = common.stored(earlier.select("block", "length", F.coalesce("before", F.lit(0)).alias("before")), "earlier")
    common.discard(by_block)
    if common.bytes_of(earlier) <= common.BROADCAST_BYTES // 4:  # a row for each task and length; else it is joined
        earlier = F.broadcast(earlier)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            _, first, _, each, sequence, offset = table[np.searchsorted(span, (length << 44) + rank, side="right") - 1].T
            turn, copy = np.divmod(rank - first, each)
            cols = [b.column(i) for i in range(5)] + [pa.array(sequence + turn), pa.array(offset + copy * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[*PIECES.names[:5], "sequence_id", "offset"])

    ranked = found.join(earlier, ["block", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("place") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
