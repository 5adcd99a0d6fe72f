"""Token ids by the tokenizers library, a unit between spaces at a time and remembered.

The byte-level pre-tokenizer never joins what stands on both sides of a single space, so a text may be cut before each
such space and the parts encoded alone. A text with a space beside other white space, or with the string of an added
token, is encoded whole: ids are always those of the library's plain call."""

from __future__ import annotations

import itertools
import os
import re
from array import array

import numpy as np

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: The same vocabulary as ranks, and what the first file adds to it.
DEFAULT_RANKS = "byte_bpe_50k.tiktoken"
ADDED = {"<|endoftext|>": 50256}
#: Units remembered in a worker, a bound on its memory: 100 to 200 bytes each.
REMEMBERED = 700_000
#: Letters up to this code point are known to be told from other characters as the library tells them; see Encoder.alike.
LAST_LETTER = 0x24F
MARKS = (".", ",", ";", ":", "!", "?")
# The character that stands for each byte in a byte-level vocabulary.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LEVEL = {b: chr(b) for b in _SHOWN} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_BESIDE = re.compile(r" \s|\s ")
_LAST = chr(LAST_LETTER)
#: The character of the space before a word.
LEAD = "\u0120"
_ASCII_BESIDE = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ", " \x0b", "\x0b ", " \x0c", "\x0c ", " \x1c", "\x1c ", " \x1d", "\x1d ", " \x1e", "\x1e ", " \x1f", "\x1f ")
_MADE: dict[str, "Encoder"] = {}
_WHOLE: dict[str, "WholeEncoder"] = {}


def tokenizer_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


def spaces_meet(text: str) -> bool:
    """Whether a space has white space beside it."""
    return any(map(text.__contains__, _ASCII_BESIDE)) if text.isascii() else _BESIDE.search(text) is not None


class Encoder(dict):
    """Maps a unit, without the space before it, to its ids as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        pre = str(self.tokenizer.pre_tokenizer)
        self.by_unit = self.tokenizer.normalizer is None and pre.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in pre
        self.plain = self.by_unit and self.alike()
        self.remembered = REMEMBERED
        self.tokenize = self.tokenizer.model.tokenize
        self.line = self.whole("\n")
        self.marks = {m: self.whole(m) for m in MARKS}
        self._sizes: np.ndarray | None = None

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def alike(self) -> bool:
        """Whether the library's pattern takes for letters what Python does, up to LAST_LETTER, and parts marks and a line
        break from words. Where not, every unit is encoded by the library as it is."""
        parts = lambda t: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(t))
        letters = all((parts(f"a{chr(c)}a") == 1) == chr(c).isalpha() for c in range(1, LAST_LETTER + 1))
        return letters and all(parts(f" a{m}") == 2 for m in MARKS) and parts(" a\nb") == 3

    def __missing__(self, unit: str) -> bytes:
        ids = self.whole(" " + unit)
        if len(self) >= self.remembered:
            self.clear()
        self[unit] = ids
        return ids

    def _word(self, word: str, lead: str) -> bytes | None:
        """The ids of a word of letters, a pre-token of its own; None where the library has to say what its letters are."""
        if word.isascii():
            as_bytes = word
        elif max(word) <= _LAST:
            as_bytes = word.encode().decode("latin-1").translate(BYTE_LEVEL)
        else:
            return None
        return array("I", [t.id for t in self.tokenize(lead + as_bytes)]).tobytes()

    def learn(self, units: set[str]) -> None:
        """Encode unknown units. What the pattern surely takes apart goes to the model a pre-token at a time: words of
        letters, a mark behind one, one line break between two of them; other units are encoded as they are."""
        if len(self) + 2 * len(units) > self.remembered:
            self.clear()
        odd, get, marks, word_ids = [], self.get, self.marks, self._word
        for u in units if self.plain else ():
            if u.isalpha():
                ids = word_ids(u, LEAD)
                if ids is not None:
                    self[u] = ids
                    continue
            elif (mark := marks.get(u[-1:])) is not None and (word := u[:-1]).isalpha():
                ids = get(word)
                if ids is None and (ids := word_ids(word, LEAD)) is not None:
                    self[word] = ids
                if ids is not None:
                    self[u] = ids + mark
                    continue
            else:
                left, line, right = u.partition("\n")
                end = b"" if right.isalpha() else marks.get(right[-1:])
                if line and left and right and end is not None and (end == b"" or right[:-1].isalpha()):
                    stop = b"" if left.isalpha() else marks.get(left[-1:])
                    if stop is not None and (stop == b"" or left[:-1].isalpha()):
                        first, second = word_ids(left if stop == b"" else left[:-1], LEAD), word_ids(right if end == b"" else right[:-1], "")
                        if first is not None and second is not None:
                            self[u] = first + stop + self.line + second + end
                            continue
            odd.append(u)
        for some in itertools.batched(odd if self.plain else units, 4096):
            for u, e in zip(some, self.tokenizer.encode_batch_fast([" " + u for u in some], add_special_tokens=False), strict=True):
                self[u] = array("I", e.ids).tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes."""
        out: list = []
        waiting: list[tuple[int, list, list[int]]] = []
        unknown: set[str] = set()
        for text in texts:
            units = text.split(" ")
            if len(units) == 1 or not self.by_unit or " " in (text[0], text[-1]) or spaces_meet(text) or any(a in text for a in self.added):
                out.append(self.whole(text) if text else b"")
                continue
            found = list(map(self.get, units))
            found[0] = self.whole(units[0])
            if None in found:
                gaps = [i for i, x in enumerate(found) if x is None]
                unknown.update([units[i] for i in gaps])
                waiting.append((len(out), found, gaps))
                out.append(units)
            else:
                out.append(b"".join(found))
        if unknown:
            self.learn(unknown)
        for at, found, gaps in waiting:
            units = out[at]
            for i in gaps:
                found[i] = self[units[i]]
            out[at] = b"".join(found)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    @property
    def byte_lengths(self) -> np.ndarray:
        """Bytes of text behind each id; a byte-level vocabulary writes each byte as one character."""
        if self._sizes is None:
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
            self._sizes = np.zeros(max(vocab.values(), default=-1) + 1, dtype=np.int64)
            for token, i in vocab.items():
                self._sizes[i] = len(token.encode()) if token in added else len(token)
        return self._sizes


class WholeEncoder:
    """Encodes texts whole and tells where each token ends, in bytes.

    A `.tiktoken` file of byte-level ranks is read by the tiktoken library, with the pattern and the added tokens that go with
    it; any other file by the tokenizers library, whose offsets tell the ends, or for a byte-level vocabulary the tokens' lengths."""

    def __init__(self, path: str, pattern: str | None = None, added: dict[str, int] | None = None):
        self.library = self.plain = None
        if path.endswith(".tiktoken"):
            import base64

            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.plain = tiktoken.Encoding("ranks", pat_str=pattern or default_pattern(), mergeable_ranks=ranks, special_tokens=added or {})
            lengths = {rank: len(token) for token, rank in ranks.items()} | {i: len(t.encode()) for t, i in (added or {}).items()}
            self.lengths = np.zeros(max(lengths, default=-1) + 1, dtype=np.int64)
            self.lengths[list(lengths)] = list(lengths.values())
        else:
            self.library = Encoder(path)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids, and for each the place in the UTF-8 bytes where it ends."""
        if self.plain is not None:
            ids = self.plain.encode_to_numpy(text, allowed_special="all")
            return ids, np.cumsum(self.lengths[ids])
        found = self.library.tokenizer.encode(text, add_special_tokens=False)
        ids = np.array(found.ids, dtype=np.uint32)
        if self.library.by_unit:
            return ids, np.cumsum(self.library.byte_lengths[ids])
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        return ids, at[np.array([e for _, e in found.offsets], dtype=np.int64)]


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def ranks_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_RANKS)


def whole_encoder(path: str) -> WholeEncoder:
    """One in a worker for each file; the default ranks come with their one added token."""
    if path not in _WHOLE:
        _WHOLE[path] = WholeEncoder(path, added=ADDED if path.endswith(DEFAULT_RANKS) else None)
    return _WHOLE[path]


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """One encoder in a worker for each vocabulary."""
    if path not in _MADE:
        _MADE[path] = Encoder(path)
    _MADE[path].remembered = remembered
    return _MADE[path]
