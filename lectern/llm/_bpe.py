"""Byte-level BPE over Arrow batches: pieces met before are not encoded again.

The tokenizer first cuts a text into pieces (words with their leading blank,
numbers, punctuation, white space) and then encodes each piece on its own. The
cut is made here with numpy on the UTF-8 bytes of whole batches; pieces that
the memo does not hold go straight to the model of the tokenizers library, which
neither cuts nor aligns them again. The memo is a direct-mapped table of fixed
size. Texts with characters outside ASCII, the
Latin signs and letters U+00A1-U+024F, dashes, quotes and dots U+2010-U+2027 and
currency signs U+20A0-U+20BF, or with the content of an added token such as
``<|endoftext|>``, are encoded whole by the library; so are all texts where the
file asks for another way to cut or for a normalizer.
"""

from __future__ import annotations

import ctypes
import functools
import json
import os
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

if TYPE_CHECKING:
    from tokenizers import Tokenizer

OTHER, LETTER, NUMBER, SPACE, UNSURE = 0, 1, 2, 3, 4
#: What follows an apostrophe as a piece of its own.
SUFFIXES = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: The way of cutting that ``cut`` follows.
CUTTER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xBF58476D1CE4E5B9)
PAD = 64
#: Pieces that are looked up at a time.
BLOCK = 1 << 16


def _byte_classes() -> np.ndarray:
    """Class of each UTF-8 byte. C3-C9 lead Latin letters, 80-BF follow them; all else beyond ASCII is unsure."""
    out = np.full(256, UNSURE, np.uint8)
    for b in range(128):
        c = chr(b)
        out[b] = LETTER if c.isalpha() else NUMBER if c.isdigit() else SPACE if b == 32 or 9 <= b <= 13 else OTHER
    out[0x80:0xC0] = LETTER
    out[0xC3:0xCA] = LETTER
    return out


CLASSES = _byte_classes()


def _latin_signs() -> np.ndarray:
    """Class of U+00A1 to U+00BF by their second byte; what stands before them (controls, the no-break space) stays unsure."""
    out = np.full(256, UNSURE, np.uint8)
    out[0xA1:0xC0] = OTHER
    out[[0xAA, 0xB5, 0xBA]] = LETTER
    out[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = NUMBER
    return out


SIGNS = _latin_signs()


def _byte_letters() -> np.ndarray:
    """Code point that stands for each byte in a byte-level vocabulary: its own where it prints, else one from U+0100 on."""
    out = np.arange(256, dtype="<u2")
    hidden = [*range(33), *range(127, 161), 173]
    out[hidden] = 256 + np.arange(len(hidden))
    return out


LETTERS = _byte_letters()


def kinds_of(data: np.ndarray, n: int) -> np.ndarray:
    """Class of each of the first ``n`` bytes; ``data`` has two more. Signs of Latin texts beyond ASCII (quotes, dashes, currencies, times and
    divided by) get the class of their character on all of their bytes."""
    kind = CLASSES[data[:n]]
    two = np.flatnonzero(data[:n] == 0xC2)
    second = SIGNS[data[two + 1]]
    kind[two], kind[two + 1] = second, np.where(second == UNSURE, LETTER, second)
    three = np.flatnonzero(data[:n] == 0xE2)
    b, c = data[three + 1], data[three + 2]
    three = three[((b == 0x80) & (c >= 0x90) & (c <= 0xA7)) | ((b == 0x82) & (c >= 0xA0) & (c <= 0xBF))]
    for k in range(3):
        kind[three + k] = OTHER
    signs = np.flatnonzero((data[:n] == 0xC3) & ((data[1 : n + 1] == 0x97) | (data[1 : n + 1] == 0xB7)))
    kind[signs] = kind[signs + 1] = OTHER
    return kind
#: Keeps the first n bytes of a little-endian word.
KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def give_back() -> None:
    """Hands free memory back to the machine: idle Python workers stay, and share an executor's limit with its JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A partition function that gives memory back once its partition is through."""

    @functools.wraps(run)
    def out(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return out


def sparing(f: Callable) -> Callable:
    """A function of groups that gives memory back once a group is through, when nothing holds its arrays any more."""

    def one(rows: pa.Table) -> pa.Table:
        found = f(rows)
        give_back()
        return found

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        found = f(left, right)
        give_back()
        return found

    return one if f.__code__.co_argcount == 1 else two  # Spark looks at the number of arguments


def slices(column: pa.Array, most_bytes: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column with at most ``most_bytes`` each, or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    a, total = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > a and total + s > most_bytes:
            yield a, i
            a, total = i, 0
        total += s
    if a < len(sizes):
        yield a, len(sizes)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in order, PAD zeros after them, and the texts' offsets (null: empty)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    out = np.zeros(int(offsets[-1] - offsets[0]) + PAD, np.uint8)
    out[: len(out) - PAD] = data[offsets[0] : offsets[-1]]
    return out, offsets - offsets[0]


def hash_pieces(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hash of byte ranges, eight bytes at a time. ``data`` has PAD spare bytes."""
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    h = sizes.astype(np.uint64) * MIX
    live, at = np.arange(len(starts)), 0
    while len(live):
        left = sizes[live] - at
        part = words[starts[live] + at] & KEEP[np.minimum(left, 8)]
        x = (h[live] ^ part) * MIX2
        x ^= x >> np.uint64(29)
        x *= MIX
        h[live] = x ^ (x >> np.uint64(32))
        at += 8
        live = live[left > 8]
    return h


def spelled(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[str]:
    """Byte ranges in the letters of a byte-level vocabulary, where no byte is a blank. There is a range, and none is empty."""
    ends = np.cumsum(sizes)
    n = int(ends[-1])
    at = np.repeat(starts - (ends - sizes), sizes)
    at += np.arange(n)
    out, inside = np.full(n + len(sizes), 32, "<u2"), np.ones(n + len(sizes), bool)
    inside[ends + np.arange(len(sizes))] = False
    out[inside] = LETTERS[data[at]]
    return out[:-1].tobytes().decode("utf-16-le").split(" ")


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces of all texts, and which texts hold unsure characters."""
    n = int(offsets[-1])
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    unsure = np.zeros(len(offsets) - 1, bool)
    if not n:
        return np.zeros(0, np.int64), unsure
    data = data[: n + 2]
    kind = kinds_of(data, n)
    begins = offsets[full]
    odd = np.flatnonzero(kind == UNSURE)
    unsure[full[np.searchsorted(begins, odd, side="right") - 1]] = True
    new = np.empty(n + 1, bool)
    new[0] = new[n] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:n])
    new[begins] = True
    text_end = np.zeros(n + 1, bool)
    text_end[begins] = True
    text_end[n] = True
    # white space before other characters: its last one stands apart, a blank joins what follows
    at = np.flatnonzero(kind == SPACE)
    last = at[new[at + 1] & ~text_end[at + 1]]
    new[last] = True
    new[last[data[last] == 32] + 1] = False
    # an apostrophe alone, with no blank before it, takes s, t, re, ve, m, ll or d along
    quote = np.flatnonzero(data[:n] == 39)
    quote = quote[new[quote] & new[quote + 1] & ~text_end[quote + 1]]
    for i in quote.tolist():
        after = data[i + 1 : i + 3].tobytes()
        for s in SUFFIXES:
            stop = i + 1 + len(s)
            if after.startswith(s) and stop <= n and not text_end[i + 1 : stop].any():
                new[i + 1 : stop] = False
                new[stop] = True
                break
    return np.flatnonzero(new[:n]), unsure


@functools.lru_cache(maxsize=1)
def library(path: str) -> Tokenizer:
    """The library's tokenizer, once for each process: every load leaves some megabytes behind that are never given back."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Encodes batches of texts with a memo of ``1 << bits`` pieces and at most ``most_ids`` ids."""

    def __init__(self, path: str, bits: int = 20, most_ids: int = 4_000_000):
        self.tokenizer = library(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        cutter = self.tokenizer.pre_tokenizer
        self.known = cutter is not None and self.tokenizer.normalizer is None and json.loads(cutter.__getstate__()) == CUTTER
        self.mask = np.uint64((1 << bits) - 1)
        self.most_ids = most_ids
        self.clear()

    def clear(self) -> None:
        n = int(self.mask) + 1
        self.keys, self.at, self.size = np.zeros(n, np.uint64), np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, spelled in the vocabulary's letters, and how many each has."""
        tokenize, ids, n_ids = self.model.tokenize, [], []
        for piece in pieces:
            found = [token.id for token in tokenize(piece)]
            ids += found
            n_ids.append(len(found))
        return np.array(ids, np.uint32), np.array(n_ids, np.int64)

    def _add(self, flat: np.ndarray) -> int:
        """Where ``flat`` stands in the store of ids."""
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(flat), len(self.ids)), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return self.used - len(flat)

    def _find(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of ids of each piece, some thousand pieces at a time: what stands beside them takes memory too."""
        if self.used > self.most_ids:
            self.clear()
        at, size = np.empty(len(starts), np.int32), np.empty(len(starts), np.int32)
        for a in range(0, len(starts), BLOCK):
            part = slice(a, a + BLOCK)
            at[part], size[part] = self._find_block(data, starts[part], sizes[part])
        return at, size

    def _find_block(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = hash_pieces(data, starts, sizes) | np.uint64(1)  # 0 is an empty slot
        slot = (keys >> np.uint64(20)) & self.mask
        at, size = self.at[slot], self.size[slot]
        miss = np.flatnonzero(self.keys[slot] != keys)
        if len(miss):
            _, first, where = np.unique(keys[miss], return_index=True, return_inverse=True)
            new = miss[first]
            flat, n_ids = self._library(spelled(data, starts[new], sizes[new]))
            base = self._add(flat) + np.cumsum(n_ids) - n_ids
            at[miss], size[miss] = base[where], n_ids[where]
            self.keys[slot[new]], self.at[slot[new]], self.size[slot[new]] = keys[new], base, n_ids
        return at, size

    def encode(self, column: pa.Array, count_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order (or none), and the number of ids of each text."""
        data, offsets = utf8(column)
        starts, unsure = cut(data, offsets)
        unsure |= not self.known
        for content in self.added:
            unsure |= np.asarray(pc.fill_null(pc.match_substring(column, content), False))
        sizes = np.diff(starts, append=offsets[-1])
        counts = np.zeros(len(column), np.int64)
        owner = np.searchsorted(offsets, starts, side="right") - 1
        if unsure.any():
            sure = ~unsure[owner]
            starts, sizes, owner = starts[sure], sizes[sure], owner[sure]
        at, n_ids = self._find(data, starts, sizes) if len(starts) else (np.zeros(0, np.int32),) * 2
        counts += np.bincount(owner, n_ids, len(column)).astype(np.int64)
        whole = {}
        for i in np.flatnonzero(unsure).tolist():
            text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
            whole[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            counts[i] = len(whole[i])
        if count_only:
            return np.zeros(0, np.uint32), counts
        before = np.cumsum(n_ids) - n_ids
        flat = self.ids[np.repeat(at - before, n_ids) + np.arange(int(n_ids.sum()))] if len(starts) else np.zeros(0, np.uint32)
        if whole:
            ends = np.cumsum(np.where(unsure, 0, counts))
            parts, a = [], 0
            for i, ids in whole.items():
                parts += [flat[a : ends[i]], ids]
                a = ends[i]
            flat = np.concatenate([*parts, flat[a:]])
        return flat, counts
