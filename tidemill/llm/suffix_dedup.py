"""Removal of repeated byte strings, by suffix sorting with hash comparisons."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import hashing, repeats

#: Bytes of a repeated string; bytes of the gram that anchors a window.
WINDOW, GRAM = 200, 64
RESULT = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def read_bytes(texts: list[bytes]) -> list[np.ndarray]:
    return [hashing.BYTE_VALUES[np.frombuffer(t, dtype=np.uint8)] for t in texts]


def plain_bytes(text: bytes) -> tuple[bytes, None]:
    return text, None


class Suffixes:
    """Suffixes of a text, compared over their first `window` bytes by prefix hashes."""

    def __init__(self, data: np.ndarray, window: int):
        self.data, self.window = data, window
        self.prefix = hashing.Prefix(hashing.BYTE_VALUES[data])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that suffixes a and b have in common: binary search for the longest extension with equal hashes."""
        low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), self.window, dtype=np.int64)
        for _ in range(self.window.bit_length()):
            mid = (low + high + 1) >> 1
            same = self.prefix.raw(a, a + mid) == self.prefix.raw(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before b, or, where or_equal, does not sort behind it."""
        n = self.common(a, b)
        end = n >= self.window
        n = np.minimum(n, self.window - 1)
        return np.where(end, or_equal, self.data[a + n] < self.data[b + n])


def merge_sort(s: Suffixes, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of suffixes `at` within groups (`group` ascends). All runs of a round are merged at once: an element's
    place is its place in its own run and its rank in the neighbouring run, found by binary search."""
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(first, len(group)))
    begin, length = np.repeat(first, size), np.repeat(size, size)
    order = np.arange(len(at))
    width = 1
    while width < (size.max() if len(size) else 0):
        place = np.arange(len(at)) - begin
        run = place // width
        left = run % 2 == 0
        start = np.where(left, (run + 1) * width, (run - 1) * width)
        stop = np.minimum(start + width, length)
        target = place.copy()
        active = np.flatnonzero(start < length)
        lo, hi = start[active], stop[active]
        mine, b, is_left = at[order[active]], begin[active], left[active]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            other = at[order[b[open_] + mid]]
            smaller = s.before(other, mine[open_], ~is_left[open_])  # a left run's equals go first
            lo[open_] = np.where(smaller, mid + 1, lo[open_])
            hi[open_] = np.where(smaller, hi[open_], mid)
        rank = lo - start[active]
        pair = (run[active] // 2) * 2 * width
        own = place[active] - run[active] * width
        target[active] = pair + own + rank
        moved = np.empty_like(order)
        moved[begin + target] = order
        order = moved
        width *= 2
    return order


def match(key: np.ndarray, doc: np.ndarray, bodies: list[bytes], head: np.ndarray, window: int, earlier: bool) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """The number of windows of each zone; which zones are equal to others; and masks of the windows of those that differ."""
    length = np.array([len(b) for b in bodies])
    data, base = np.frombuffer(b"".join(bodies), dtype=np.uint8), np.cumsum(length) - length
    s = Suffixes(data, window)
    zone = repeats.equal_zones(key, head, length, base, data, s.prefix)

    def windows(some: np.ndarray) -> list[np.ndarray]:
        return compare_windows(s, key[some], base[some], length[some] - window + 1, head[some])

    return (length - window + 1, *repeats.by_zones(key, doc, zone, earlier, windows))


def compare_windows(s: Suffixes, key: np.ndarray, base: np.ndarray, sizes: np.ndarray, head: np.ndarray) -> list[np.ndarray]:
    """For each zone, which of its window starts have an equal window among the others. Windows are put in groups of
    the same gram at the same offset; each group's suffixes are sorted and neighbours with a whole window in common
    are equal, which their bytes then have to confirm."""
    data, window = s.data, s.window
    zone = np.repeat(np.arange(len(key)), sizes)
    step = np.arange(len(zone)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at, offset = base[zone] + step, head[zone] - step
    order = np.lexsort((zone, offset, key[zone]))
    same = (np.diff(key[zone][order]) == 0) & (np.diff(offset[order]) == 0)
    several = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    group = np.cumsum(np.concatenate(([True], ~same)))[several]
    order = order[several]
    out = np.zeros(len(zone), dtype=bool)
    if len(order):
        order = order[merge_sort(s, at[order], group)]
        next_to = np.flatnonzero(group[1:] == group[:-1])
        pairs = next_to[s.common(at[order[next_to]], at[order[next_to + 1]]) >= window]
        wrong: set[int] = set()
        for k in range(0, len(pairs), 20_000):
            p = pairs[k : k + 20_000]
            reach = np.arange(window)
            equal = (data[at[order[p]][:, None] + reach] == data[at[order[p + 1]][:, None] + reach]).all(axis=1)
            out[order[p[equal]]] = out[order[p[equal] + 1]] = True
            wrong.update(group[p[~equal]].tolist())
        for g in wrong:  # different bytes with one hash: settle the group by its bytes
            members: dict[bytes, list[int]] = {}
            for i in order[group == g]:
                members.setdefault(data[at[i] : at[i] + window].tobytes(), []).append(i)
            for m in members.values():
                out[m] = len(m) > 1
    return np.split(out, np.cumsum(sizes)[:-1])


def cut_bytes(text: bytes, s: np.ndarray, e: np.ndarray, window: int) -> tuple[bytes, int, int]:
    mask, runs = repeats.covered(s, e, window, len(text))
    return np.frombuffer(text, dtype=np.uint8)[~mask].tobytes(), int(mask.sum()), runs


def suffix_dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Remove each byte that is covered by a string of `window` bytes that also starts anywhere else, in the same
    document or another. Overlaps count; strings are judged on the input. Matches never cross documents.

    Returns for each document doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (lowercase hex
    of the bytes that remain), and, if with_text, kept_text: what remains as text, without code points that lost bytes,
    and text_hash (xxhash64 of the whole text), which tells rows apart that repeat a doc_id.

    A null or empty text has no bytes. A row that is repeated in full is a copy like any other, so both lose what
    repeats. Rows that repeat a doc_id with another text are documents of their own. A null doc_id stays null. An
    empty table gives no rows. Other columns are ignored."""
    gram = min(GRAM, max(1, window // 3))

    def finish(text: bytes, s: np.ndarray, e: np.ndarray) -> tuple:
        kept, removed, runs = cut_bytes(text, s, e, window)
        row = (len(text), removed, runs, hashlib.sha256(kept).hexdigest())
        return (*row, kept.decode(errors="ignore")) if with_text else row

    schema = RESULT.append(pa.field("kept_text", pa.string())) if with_text else RESULT
    ddl = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    return repeats.mark_repeats(docs, read_bytes, plain_bytes, window, gram, False, match, finish, schema, ddl, with_hash=with_text)
