"""Token counts of the sections of documents, attributed by offsets: a document is encoded whole, and its tokens' spans are
joined with the spans of its sections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

RULES = ("first", "last", "largest")
ROWS = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())])


def attribute(ends: np.ndarray, cuts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Interval join of tokens with sections, both in byte offsets of one text.

    ends: where each token ends (each begins where the one before ended). cuts: the start of every section and the
    text's end. Returns for each token its section and whether it crosses a boundary."""
    starts = np.concatenate(([0], ends[:-1]))
    first = np.searchsorted(cuts, starts, side="right") - 1
    last = np.maximum(np.searchsorted(cuts, ends, side="left") - 1, first)
    first, last = np.minimum(first, len(cuts) - 2), np.minimum(last, len(cuts) - 2)
    crossing = last > first
    if rule == "first":
        return first, crossing
    if rule == "last":
        return last, crossing
    owner = first.copy()
    for i in np.flatnonzero(crossing):  # the section with most of the token's bytes, the earlier of equals
        k = np.arange(first[i], last[i] + 1)
        owner[i] = k[np.argmax(np.minimum(cuts[k + 1], ends[i]) - np.maximum(cuts[k], starts[i]))]
    return owner, crossing


def token_counts(docs: DataFrame, rule: str = "first", tokenizer: str | None = None, separator: str = "\n") -> DataFrame:
    """Count tokens in each section of each document, where a document is encoded once and whole. tokenizer: a file of ranks for
    the tiktoken library (by default), or one for the tokenizers library, which takes some five times as long.

    A section ends with a separator, one ASCII character: by default, lines with the line breaks that end them. A token
    that crosses from one section into the next belongs to one section only, by the rule: `first`, the section of its first byte; `last`, that of its last byte;
    `largest`, that with most of its bytes, the earlier of equals. So counts add up to the document's tokens.

    One row for each section: doc_id, section (from 0), char_start, char_end (code points), n_tokens,
    n_crossing (tokens counted here that reach into another section). A text that is null or empty is one section
    0..0 without tokens. Repeated rows give repeated results; no row leaves its task. Other columns are ignored."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if len(separator) != 1 or not separator.isascii():
        raise ValueError("separator must be one ASCII character")
    common.bound_batches(docs.sparkSession)
    mark = ord(separator)
    path = tokens.ranks_path(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = tokens.whole_encoder(path)
        for batch in common.pieces(batches, 64):
            cols: list[list[np.ndarray]] = [[] for _ in ROWS]
            for doc_id, text in zip(np.asarray(batch.column(0).fill_null(common.NULL_ID)), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                cuts = np.concatenate(([0], np.flatnonzero(data == mark) + 1))
                if cuts[-1] != len(data) or len(cuts) == 1:
                    cuts = np.append(cuts, len(data))
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                _, ends = code.encode(text)
                n = len(cuts) - 1
                owner, crossing = attribute(ends, cuts, rule) if len(ends) else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool))
                parts = (np.full(n, doc_id), np.arange(n), chars[cuts[:-1]], chars[cuts[1:]], np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n))
                for c, x in zip(cols, parts, strict=True):
                    c.append(x)
            if cols[0]:
                out = [pa.array(np.concatenate(c)).cast(f.type) for c, f in zip(cols, ROWS, strict=True)]
                ids = np.concatenate(cols[0])
                out[0] = pa.array(ids, mask=ids == common.NULL_ID)
                yield pa.RecordBatch.from_arrays(out, schema=ROWS)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(count, "doc_id long, section int, char_start long, char_end long, n_tokens long, n_crossing long")
