"""Removal of repeated word sequences, by suffix trees over groups of suffixes that share a prefix."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, hashing, repeats

#: Words of a window; words of the gram that anchors it.
WINDOW, GRAM = 50, 12
RESULT = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def read_words(texts: list[bytes]) -> list[np.ndarray]:
    """A hash for each word of each text."""
    lengths = [len(t) + 1 for t in texts]
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    starts, ends = common.word_bounds(data, common.SPACES)
    h = hashing.Prefix(hashing.BYTE_VALUES[data]).of(starts, ends)
    return np.split(h, np.searchsorted(starts, np.cumsum(lengths)[:-1]))


def plain_words(text: bytes) -> tuple[bytes, np.ndarray]:
    """The words joined by one space, and where each begins; bytes.split() parts at the six separators."""
    words = text.split()
    return b" ".join(words), np.concatenate(([0], np.cumsum([len(w) + 1 for w in words], dtype=np.int64)))


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of texts: their hashes, a number for each different word, told apart by its bytes, and where each text begins."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    starts, ends = common.word_bounds(data, common.SPACES)
    h = hashing.Prefix(hashing.BYTE_VALUES[data]).of(starts, ends)
    _, first, ids = np.unique(h, return_index=True, return_inverse=True)
    size, of = ends - starts, first[ids]
    same = bool((size == size[of]).all())
    if same:
        reach = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        same = bool((data[np.repeat(starts, size) + reach] == data[np.repeat(starts[of], size) + reach]).all())
    if not same:  # two words with one hash
        known: dict[bytes, int] = {}
        raw = data.tobytes()
        ids = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    begins = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
    return h, ids.astype(np.int32), begins


class Subtree:
    """The part of a suffix tree below a prefix, built a level at a time.

    Each round reads the next words of all suffixes that still share their path with another one and branches the
    nodes by them; the fewer suffixes are left, the more words are read at a time. A suffix that stands alone is a leaf
    and is read no further. Nodes that reach `depth` words are the deep internal nodes: each is a repeat."""

    def __init__(self, prefix: hashing.Prefix, at: np.ndarray, group: np.ndarray, depth: int):
        self.node = np.full(len(at), -1, dtype=np.int64)  # of each suffix at full depth; -1: a leaf above it
        self.depths: list[int] = []
        active, path = np.arange(len(at)), group.astype(np.int64)
        read = 0
        step = 4
        while True:
            order = np.argsort(path, kind="stable")
            active, path = active[order], path[order]
            same = path[1:] == path[:-1]
            inner = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            active, path = active[inner], path[inner]
            if read >= depth or not len(active):
                break
            step = min(depth - read, step if len(active) > 1000 else 2 * step)
            words = prefix.of(at[active] + read, at[active] + read + step).view(np.int64)
            order = np.lexsort((words, path))
            active, path, words = active[order], path[order], words[order]
            path = np.cumsum(np.concatenate(([True], (path[1:] != path[:-1]) | (words[1:] != words[:-1]))))
            read += step
            self.depths.append(read)
        self.node[active] = path


def match(key: np.ndarray, doc: np.ndarray, bodies: list[bytes], head: np.ndarray, window: int, earlier: bool) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """The number of windows of each zone; which zones are equal to earlier ones; and masks of the windows of those that differ."""
    h, ids, begins = word_ids(bodies)
    length = np.diff(begins)
    prefix = hashing.Prefix(h)
    zone = repeats.equal_zones(key, head, length, begins[:-1], ids, prefix)

    def windows(some: np.ndarray) -> list[np.ndarray]:
        return compare_windows(prefix, ids, key[some], doc[some], begins[:-1][some], length[some] - window + 1, head[some], window, earlier)

    return (length - window + 1, *repeats.by_zones(key, doc, zone, earlier, windows))


def compare_windows(prefix: hashing.Prefix, ids: np.ndarray, key: np.ndarray, doc: np.ndarray, base: np.ndarray, sizes: np.ndarray, head: np.ndarray, window: int, earlier: bool) -> list[np.ndarray]:
    """For each zone, which of its windows end below a deep internal node with a leaf of an earlier document. The tree is
    built by hashes; the words of all suffixes below a deep node are then compared with those of its first one."""
    zone = np.repeat(np.arange(len(key)), sizes)
    step = np.arange(len(zone)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = base[zone] + step
    order = np.lexsort((head[zone] - step, key[zone]))
    k, off = key[zone][order], (head[zone] - step)[order]
    group = np.empty(len(zone), dtype=np.int64)
    group[order] = np.cumsum(np.concatenate(([True], (k[1:] != k[:-1]) | (off[1:] != off[:-1]))))
    node = Subtree(prefix, at, group, window).node
    out = np.zeros(len(zone), dtype=bool)
    deep = np.flatnonzero(node >= 0)
    if len(deep):
        _, first, place = np.unique(node[deep], return_index=True, return_inverse=True)
        wrong: set[int] = set()
        reach = np.arange(window)
        for i in range(0, len(deep), 20_000):
            some = slice(i, i + 20_000)
            equal = (ids[at[deep[some]][:, None] + reach] == ids[at[deep[first[place[some]]]][:, None] + reach]).all(axis=1)
            wrong.update(place[some][~equal].tolist())
        for g in wrong:  # different words with one hash: settle the node by its words
            parts: dict[bytes, int] = {}
            for i in np.flatnonzero(place == g):
                place[i] = parts.setdefault(ids[at[deep[i]] : at[deep[i]] + window].tobytes(), place.max() + 1)
        least = np.full(place.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, place, doc[zone[deep]])
        several = np.bincount(place)[place] > 1
        out[deep] = least[place] < doc[zone[deep]] if earlier else several
    return np.split(out, np.cumsum(sizes)[:-1])


def substring_dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Remove each word that is covered by a window of `window` consecutive words whose sequence also starts in a
    document with a smaller doc_id. Words are `[^\\\\x20\\\\x09-\\\\x0D]+`, unchanged; windows are judged on the input.

    Returns for each document doc_id, n_words, n_removed, kept_sha256 (lowercase hex of the words that remain, joined
    by a space), and, if with_text, kept_text.

    A null or empty text has no words. Rows that repeat a doc_id have no smaller id among them, so they take nothing
    from each other. A null doc_id counts as smallest and stays null. An empty table gives no rows. Other columns are
    ignored. Whole zones that are copies are told by 192 bits of hashes; in the subtrees words are compared as they are."""
    gram = min(GRAM, max(1, window // 3))

    def finish(text: bytes, s: np.ndarray, e: np.ndarray) -> tuple:
        data = np.frombuffer(text, dtype=np.uint8)
        starts, ends = common.word_bounds(data, common.SPACES)
        mask, _ = repeats.covered(s, e, window, len(starts))
        kept = b" ".join(text[a:b] for a, b in zip(starts[~mask].tolist(), ends[~mask].tolist(), strict=True))
        row = (len(starts), int(mask.sum()), hashlib.sha256(kept).hexdigest())
        return (*row, kept.decode()) if with_text else row

    schema = RESULT.append(pa.field("kept_text", pa.string())) if with_text else RESULT
    ddl = "n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return repeats.mark_repeats(docs, read_words, plain_words, window, gram, True, match, finish, schema, ddl)
