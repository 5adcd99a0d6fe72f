"""Token ids in seekable files: independent zstandard frames, per-frame checksums and a trailing seek table."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

# Fixed values of the seekable zstandard format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_FOOTER = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
#: Ids in a frame: what a reader of one document decompresses at least.
FRAME_IDS = 16_384
MANIFEST = "file long, path string, n_docs long, n_ids long, lowest long, highest long"


def open_store(where: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI or absolute path that driver and executors share."""
    return pafs.FileSystem.from_uri(where if "://" in where or where.startswith("file:") else f"file://{where}")


class Writer:
    """Writes one file. Ids are cut into frames of frame_ids whatever document they belong to."""

    def __init__(self, out, frame_ids: int = FRAME_IDS):
        self.out, self.frame_ids = out, frame_ids
        self.packer = zstandard.ZstdCompressor(level=1)
        self.waiting = bytearray()
        self.table: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """The ids are little-endian unsigned 32-bit bytes."""
        self.docs.append((common.NULL_ID if doc_id is None else doc_id, len(ids) // 4))
        self.waiting += ids
        size = 4 * self.frame_ids
        while len(self.waiting) >= size:
            self._frame(bytes(self.waiting[:size]))
            del self.waiting[:size]

    def _frame(self, raw: bytes) -> None:
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        """Ends with the index of documents, then the seek table, each in a skippable frame."""
        if self.waiting:
            self._frame(bytes(self.waiting))
        index = self.packer.compress(struct.pack("<II", self.frame_ids, len(self.docs)) + np.array([d for d, _ in self.docs], dtype="<i8").tobytes() + np.array([n for _, n in self.docs], dtype="<u8").tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        entries = [*self.table, (8 + len(index), 0, 0)]
        body = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IBI", len(entries), CHECKSUM_FLAG, SEEKABLE_FOOTER)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(body)) + body)


class Reader:
    """Reads the seek table and the index, then only frames that are asked for."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_FOOTER or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end")
        source.seek(size - 9 - 12 * count)
        table = np.frombuffer(source.read(12 * count), dtype="<u4").reshape(-1, 3)
        at = np.concatenate(([0], np.cumsum(table[:, 0], dtype=np.int64)))
        self.table, self.at = table[:-1], at
        source.seek(int(at[-2]) + 8)
        index = zstandard.ZstdDecompressor().decompress(source.read(int(table[-1, 0]) - 8))
        self.frame_ids, n = struct.unpack("<II", index[:8])
        self.doc_ids = np.frombuffer(index, dtype="<i8", count=n, offset=8)
        self.lengths = np.frombuffer(index, dtype="<u8", count=n, offset=8 + 8 * n).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            self.source.seek(int(self.at[k]))
            raw = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k} does not match its checksum")
            self.last = (k, raw)
        return self.last[1]

    def stretches(self, i: int) -> Iterator[bytes]:
        """The ids of the i-th document, a frame's share at a time."""
        at, end = int(self.starts[i]), int(self.starts[i] + self.lengths[i])
        while at < end:
            k = at // self.frame_ids
            stop = min(end, (k + 1) * self.frame_ids)
            yield self.frame(k)[4 * (at - k * self.frame_ids) : 4 * (stop - k * self.frame_ids)]
            at = stop


def read_documents(path: str, doc_ids: Iterable[int]) -> dict[int, np.ndarray]:
    """The ids of some documents of one file, from their frames alone."""
    store, p = open_store(path)
    with store.open_input_file(p) as f:
        r = Reader(f, f.size())
        want = np.fromiter(doc_ids, dtype=np.int64)
        return {int(r.doc_ids[i]): np.frombuffer(b"".join(r.stretches(i)), dtype="<u4") for i in np.flatnonzero(np.isin(r.doc_ids, want))}


def write_token_files(docs: DataFrame, where: str, tokenizer: str | None = None, end_id: int = 2, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Encode every document, end_id behind it, and write ids in ascending doc_id order to files in the folder `where`.

    The rows are dealt by ranges of doc_id, a file for each range; file numbers ascend with doc_id. Returns the
    manifest, a row for each file (file, path, n_docs, n_ids, lowest, highest), stored in the shared folder.
    A task that runs again writes under a name of its own, and only the manifest of the attempt that counts names it.

    A null or empty text is the one id end_id. A null doc_id sorts first; rows that repeat a doc_id are written each,
    ordered by text. An empty table gives an empty manifest. Columns besides doc_id and text are ignored."""
    path = tokens.tokenizer_path(tokenizer)
    store, p = open_store(where)
    store.create_dir(p, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = tokens.encoder(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        part = TaskContext.get().partitionId()
        name, out, w = f"{where}/ids-{part:06d}-{uuid.uuid4().hex}.zst", None, None
        for batch in common.pieces(batches):
            if w is None:
                fs, q = open_store(name)
                out = fs.open_output_stream(q, compression=None)
                w = Writer(out, frame_ids)
            for doc_id, raw in zip(batch.column(0).to_pylist(), code.encode_all([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                w.add(doc_id, raw + end)
        if w is not None:
            w.close()
            out.close()
            row = (part, name, len(w.docs), sum(n for _, n in w.docs), w.docs[0][0], w.docs[-1][0])
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in zip(("file", "path", "n_docs", "n_ids", "lowest", "highest"), row, strict=True)})

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = chosen.repartitionByRange("doc_id", F.hash("text")).sortWithinPartitions("doc_id", F.hash("text"), "text")
    return common.stored(dealt.mapInArrow(write, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (unsigned).

    The manifest has a row for each file, so running totals over it are small; frames are checked as they are read."""
    spark = manifest.sparkSession
    rows = sorted(manifest.collect(), key=lambda r: r["file"])  # a row for each file, not for each document
    listed, before = [], 0
    for r in rows:
        listed.append((r["path"], before))
        before += r["n_ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, q = open_store(name)
                with fs.open_input_file(q) as f:
                    r = Reader(f, f.size())
                    for at in range(0, len(r.doc_ids), 4096):
                        crcs = []
                        for i in range(at, min(at + 4096, len(r.doc_ids))):
                            crc = 0
                            for s in r.stretches(i):
                                crc = zlib.crc32(s, crc)
                            crcs.append(crc)
                        ids = r.doc_ids[at : at + 4096]
                        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == common.NULL_ID), pa.array(base + r.starts[at : at + 4096]), pa.array(r.lengths[at : at + 4096]), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(listed, "path string, base long")
    return files.repartition(max(1, len(listed))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
