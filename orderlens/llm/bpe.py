"""Byte-level BPE: merges chosen by a segment tree over the ranks of adjacent pairs.

A text is cut into pieces (words with their space, numbers, punctuation, white space) by the rule
of byte-level vocabularies; each piece is merged on its own.  Over a piece of n bytes stands a
segment tree whose leaf i holds ``rank * width + i`` for the pair that starts at symbol i, or a
value larger than any rank where no merge exists.  The root is then the leftmost pair of lowest
rank.  A merge changes at most three leaves (its own, its left neighbour's, the consumed symbol's),
each updated in log n steps, until the root says that no pair is left.

Pieces repeat, so a task hashes the pieces of a batch, encodes each new one once, and gathers the
ids of all.  Trees of the same width are advanced together, one array row per piece; pieces longer
than `ROW_WIDTH` bytes have a tree of their own.  Memory is bounded by the characters of a chunk and
by `CACHE_PIECES` remembered pieces of `CACHE_LETTERS` characters (then the memory starts anew).
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from orderlens.llm import chartext as ct
from orderlens.llm.workers import released

CACHE_PIECES, CACHE_LETTERS = 400_000, 8_000_000
ROW_WIDTH = 128
# Cells of the symbol grid advanced together.
GRID_CELLS = 250_000

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3

# Code points that became letters or numbers in Unicode 16, which the vocabulary's
# cutting rule knows and Python's tables do not yet.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
    (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)


# ---- pieces -------------------------------------------------------------------------------------


@lru_cache(1)
def character_classes() -> np.ndarray:
    """Letter, number, white space or other, for every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    kind = {"L": LETTER, "N": NUMBER}
    for point in range(0x110000):
        c = unicodedata.category(chr(point))[0]
        if c in kind:
            table[point] = kind[c]
    for spans, c in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for low, high in spans:
            table[low : high + 1] = c
    table[list(ct.WHITE_SPACE)] = SPACE
    return table


def piece_starts(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Flags of the characters where a piece starts; `firsts` are the first characters of texts.

    Runs of one class are pieces.  A white-space run before something else gives up its last
    character: a plain space joins what follows, anything else stands alone.  An apostrophe that
    starts a piece takes the endings s, t, m, d, re, ve, ll with it.
    """
    n = len(codes)
    kind = character_classes()[codes]
    start = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    text_start = np.zeros(n + 3, bool)
    text_start[firsts[firsts < n]] = True
    text_start[n:] = True
    start |= text_start[:n]
    # The last white space of a run that something of the same text follows.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~text_start[1:n])
    start[last] = True
    start[last[codes[last] == 0x20] + 1] = False
    _join_endings(codes, kind, start, text_start)
    return start


def _join_endings(codes: np.ndarray, kind: np.ndarray, start: np.ndarray, text_start: np.ndarray) -> None:
    """An apostrophe that starts a piece and one of its endings become a piece; changes `start`."""
    n = len(codes)
    quote = np.flatnonzero((codes[:-1] == 0x27) & start[:-1] & (kind[1:] == LETTER) & ~text_start[1:n])
    if not len(quote):
        return
    padded = np.concatenate([codes, np.zeros(3, np.uint32)])
    one, two = padded[quote + 1], padded[quote + 2]
    inside = ~text_start[quote + 2]
    long = inside & (
        ((one == ord("r")) & (two == ord("e")))
        | ((one == ord("v")) & (two == ord("e")))
        | ((one == ord("l")) & (two == ord("l")))
    )
    short = np.isin(one, [ord(c) for c in "stmd"])
    for found, width in ((quote[short], 2), (quote[long], 3)):
        start[found + 1] = False
        after = found + width
        start[after[after < n]] = True


def word_starts(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The same for vocabularies whose words end without a space: runs of letters and of other signs
    are pieces, every number sign is one, and white space, in pieces of its own, has no ids."""
    n = len(codes)
    kind = character_classes()[codes]
    start = kind == NUMBER
    start[1:] |= kind[1:] != kind[:-1]
    text_start = np.zeros(n + 3, bool)
    text_start[firsts[firsts < n]] = True
    text_start[n:] = True
    start |= text_start[:n]
    _join_endings(codes, kind, start, text_start)
    return start


def safe_chunks(text: str, limit: int = ct.CHUNK_CHARS) -> Iterator[str]:
    """The text in parts that may be cut into pieces apart: each part but the first starts with
    white space after something else.  A part is longer than `limit` only where there is none."""
    done = 0
    white = {chr(c) for c in ct.WHITE_SPACE}
    while len(text) - done > limit:
        cut = done + limit
        while cut < len(text) and not (text[cut] in white and text[cut - 1] not in white):
            cut += 1
        yield text[done:cut]
        done = cut
    if done < len(text):
        yield text[done:]


# ---- merging ------------------------------------------------------------------------------------


class Vocabulary:
    """Ids of single bytes, ranks of merges and bytes of tokens, from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        vocab = data["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        byte_of = printable_bytes()
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        raw = [b""] * size
        for token, i in vocab.items():
            raw[i] = token.encode() if token in self.special else bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            raw[i] = token.encode()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in byte_of.items():
            self.byte_id[b] = vocab[c]
        left, right, made = (
            np.array(x, np.int64)
            for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), strict=True)
        )
        # Some vocabularies mark the last symbol of a piece.
        end = data["model"].get("end_of_word_suffix") or ""
        self.last_id = np.zeros(256, np.int64)
        for c, b in byte_of.items():
            self.last_id[b] = vocab[c + end]
        self.no_rank = len(left)
        key = (left << 32) | right
        self.pairs = {int(k): (i, int(m)) for i, (k, m) in enumerate(zip(key, made, strict=True))}
        self._hash(key, made)
        self.token_length = np.array([len(b) for b in raw], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(raw), np.uint8)

    def _hash(self, key: np.ndarray, made: np.ndarray) -> None:
        """An open table of the pairs, at most a quarter full; `reach` is the longest probe."""
        self.bits = max(4, (4 * len(key)).bit_length())
        size = 1 << self.bits
        self.slot_key = np.full(size, -1, np.int64)
        self.slot_rank = np.full(size, len(key), np.int32)
        self.slot_made = np.zeros(size, np.int32)
        self.reach = 1
        waiting, at = np.arange(len(key)), self._slot(key)
        while len(waiting):
            free = self.slot_key[at] < 0
            chosen, first = np.unique(at[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            rows = waiting[placed]
            self.slot_key[chosen], self.slot_rank[chosen], self.slot_made[chosen] = key[rows], rows, made[rows]
            left = np.ones(len(waiting), bool)
            left[placed] = False
            waiting, at = waiting[left], (at[left] + 1) & (size - 1)
            self.reach += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and new id of each pair; `no_rank` where the two do not merge."""
        key = (left.astype(np.int64) << 32) | right
        at = self._slot(key)
        seen = self.slot_key[at]
        open_ = np.flatnonzero((seen != key) & (seen >= 0))
        for _ in range(self.reach):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            seen[open_] = self.slot_key[at[open_]]
            open_ = open_[(seen[open_] != key[open_]) & (seen[open_] >= 0)]
        return np.where(seen == key, self.slot_rank[at], self.no_rank), self.slot_made[at]


def printable_bytes() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte: itself where it is a
    printable Latin-1 character, else the next free one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def merge_rows(ids: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Merge many pieces at once; row i of `ids` holds `lengths[i]` symbols.

    Returns the symbols in place and a mask of those left.  Each round takes every row's root,
    merges there, and updates the leaves and the paths above them.  All arrays are flat: symbol c
    of row r is at ``r * width + c``, node k of its tree at ``2 * r * width + k``.
    """
    rows, width = ids.shape
    kind = np.int32 if vocabulary.no_rank * width < 1 << 31 else np.int64
    none = vocabulary.no_rank * width
    column = np.arange(width, dtype=np.int32)
    alive = (column < lengths[:, None]).ravel()
    following = np.where(column + 1 < lengths[:, None], column + 1, width).astype(np.int32).ravel()
    before = np.tile(column - 1, rows)
    ids = ids.astype(np.int32).ravel()
    tree = np.full((rows, 2 * width), none, kind)
    paired = np.flatnonzero(following < width)
    rank, _ = vocabulary.look_up(ids[paired], ids[paired + 1])
    leaves = np.full(rows * width, none, kind)
    leaves[paired] = np.minimum(rank.astype(np.int64) * width + paired % width, none)
    tree[:, width:] = leaves.reshape(rows, width)
    level = width
    while level > 1:
        np.minimum(
            tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, level // 2 : level]
        )
        level //= 2
    tree = tree.ravel()
    children = tree.reshape(-1, 2)

    def put(base, c, value):
        """Set leaf c of the rows that start at `base` and renew the path to the root."""
        node = c + width
        tree[2 * base + node] = value
        for _ in range(width.bit_length() - 1):  # all leaves are equally deep
            node = node >> 1
            both = children[base + node]
            tree[2 * base + node] = np.minimum(both[:, 0], both[:, 1])

    def refresh(base, c):
        """The leaf of the pair that starts at symbol c."""
        at = base + c
        nxt = following[at]
        has = nxt < width
        rank, _ = vocabulary.look_up(ids[at], ids[base + np.where(has, nxt, 0)])
        value = rank.astype(np.int64) * width + c
        put(base, c, np.where(has & (rank < vocabulary.no_rank), value, none))

    base = np.arange(rows) * width
    base = base[tree[2 * base + 1] < none]
    while len(base):
        c = (tree[2 * base + 1] % width).astype(np.int64)
        at = base + c
        gone = following[at].astype(np.int64)
        _, made = vocabulary.look_up(ids[at], ids[base + gone])
        ids[at] = made
        alive[base + gone] = False
        after = following[base + gone]
        following[at] = after
        linked = after < width
        before[base[linked] + after[linked]] = c[linked]
        put(base, gone, none)
        refresh(base, c)
        left = before[at].astype(np.int64)
        has = left >= 0
        refresh(base[has], left[has])
        base = base[tree[2 * base + 1] < none]
    return ids.reshape(rows, width), alive.reshape(rows, width)


def merge_one(symbols: list[int], vocabulary: Vocabulary) -> list[int]:
    """The same for one long piece, with plain lists."""
    n = len(symbols)
    width = 1 << max(1, (n - 1).bit_length())
    none = vocabulary.no_rank * width
    pairs = vocabulary.pairs
    ids, following, before = list(symbols), [*range(1, n + 1)], [*range(-1, n - 1)]
    tree = [none] * (2 * width)

    def leaf(i: int) -> int:
        found = pairs.get((ids[i] << 32) | ids[following[i]]) if following[i] < n else None
        return found[0] * width + i if found else none

    def put(i: int, value: int) -> None:
        node = i + width
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a < b else b
            if tree[node] == least:
                return
            tree[node] = least
            node >>= 1

    for i in range(n):
        tree[width + i] = leaf(i)
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    gone = bytearray(n)
    while tree[1] < none:
        i = tree[1] % width
        j = following[i]
        ids[i] = pairs[(ids[i] << 32) | ids[j]][1]
        gone[j] = 1
        following[i] = following[j]
        if following[i] < n:
            before[following[i]] = i
        put(j, none)
        put(i, leaf(i))
        if before[i] >= 0:
            put(before[i], leaf(before[i]))
    return [ids[i] for i in range(n) if not gone[i]]


def encode_pieces(
    flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces `flat[start : start + size]`, one after the other, and their counts."""
    counts = np.zeros(len(sizes), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    low, width = 0, 2
    while low < ROW_WIDTH:
        rows = np.flatnonzero((sizes > low) & (sizes <= width))
        step = max(1, GRID_CELLS // width)
        for begin in range(0, len(rows), step):
            part = rows[begin : begin + step]
            lengths = sizes[part]
            grid = np.zeros((len(part), width), np.int64)
            column = ct.ranges(np.zeros(len(part), np.int64), lengths)
            grid[np.repeat(np.arange(len(part)), lengths), column] = vocabulary.byte_id[
                flat[ct.ranges(starts[part], lengths)]
            ]
            grid[np.arange(len(part)), lengths - 1] = vocabulary.last_id[flat[starts[part] + lengths - 1]]
            ids, alive = merge_rows(grid, lengths, vocabulary)
            counts[part] = alive.sum(1)
            parts.append((part, ids[alive]))
        low, width = width, width * 2
    for i in np.flatnonzero(sizes > ROW_WIDTH):
        symbols = vocabulary.byte_id[flat[starts[i] : starts[i] + sizes[i]]].tolist()
        symbols[-1] = int(vocabulary.last_id[flat[starts[i] + sizes[i] - 1]])
        merged = np.array(merge_one(symbols, vocabulary), np.int64)
        counts[i] = len(merged)
        parts.append((np.array([i]), merged))
    out = np.zeros(int(counts.sum()), np.uint32)
    begins = np.cumsum(counts) - counts
    for rows, ids in parts:
        out[ct.ranges(begins[rows], counts[rows])] = ids
    return out, counts


PieceEncoder = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


class Encoder:
    """Ids of whole texts; remembers the pieces met lately, by hash, in sorted arrays.

    A remembered piece is used only where its characters are those of the piece at hand; of pieces
    that share a hash the first one is remembered and the others are encoded each time.
    """

    def __init__(self, encode: PieceEncoder, special: dict[str, int], hashes=ct.slice_hashes, cut=piece_starts):
        self.encode = encode
        self.special = special
        self.hashes = hashes
        self.cut = cut
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begins, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)
        self.letters = np.zeros(0, np.uint32)
        self.letter_begins, self.letter_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, hashes: np.ndarray, letters: np.ndarray, sizes: np.ndarray, pieces: tuple) -> None:
        """Encode new pieces; `hashes` ascend and are not known yet, `letters` are their characters."""
        ids, counts = self.encode(*pieces)
        at = np.searchsorted(self.keys, hashes)
        self.keys = np.insert(self.keys, at, hashes)
        self.begins = np.insert(self.begins, at, len(self.pool) + np.cumsum(counts) - counts)
        self.counts = np.insert(self.counts, at, counts)
        self.letter_begins = np.insert(self.letter_begins, at, len(self.letters) + np.cumsum(sizes) - sizes)
        self.letter_counts = np.insert(self.letter_counts, at, sizes)
        self.pool = np.concatenate([self.pool, ids])
        self.letters = np.concatenate([self.letters, letters])

    def _alike(self, codes: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which pieces, that lie one after the other in `codes`, are the remembered ones `at`."""
        alike = self.letter_counts[at] == sizes
        same = np.minimum(self.letter_counts[at], sizes)
        theirs = self.letters[ct.ranges(self.letter_begins[at], same)]
        if alike.all():
            different = theirs != codes
            if not different.any():
                return alike
            alike[np.searchsorted(np.cumsum(sizes), np.flatnonzero(different), side="right")] = False
            return alike
        starts = np.cumsum(sizes) - sizes
        different = np.flatnonzero(theirs != codes[ct.ranges(starts, same)])
        alike[np.searchsorted(np.cumsum(same), different, side="right")] = False
        return alike

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, none of them empty, one after the other, and counts by text."""
        whole = "".join(texts)
        codes = ct.codes_of(whole)
        text_sizes = np.array([len(t) for t in texts], np.int64)
        firsts = np.cumsum(text_sizes) - text_sizes
        starts = np.flatnonzero(self.cut(codes, firsts))
        ends = np.append(starts[1:], len(codes))
        sizes = ends - starts
        hashes = self.hashes(codes, starts, ends)
        distinct, first, index = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_PIECES or len(self.letters) > CACHE_LETTERS:
            self.forget()
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        bytes_of = None
        if not known.all():
            bytes_of = _byte_offsets(whole, codes)
            new = first[~known]
            self._learn(distinct[~known], codes[ct.ranges(starts[new], sizes[new])], sizes[new], bytes_of(starts[new], ends[new]))
            at = np.searchsorted(self.keys, distinct)
        at = at[index]
        begins, counts, pool = self.begins[at], self.counts[at], self.pool
        alike = self._alike(codes, sizes, at)
        if not alike.all():
            other = np.flatnonzero(~alike)
            bytes_of = bytes_of or _byte_offsets(whole, codes)
            ids, own = self.encode(*bytes_of(starts[other], ends[other]))
            begins[other] = len(pool) + np.cumsum(own) - own
            counts[other] = own
            pool = np.concatenate([pool, ids])
        ids = pool[ct.ranges(begins, counts)]
        return ids, np.add.reduceat(counts, np.searchsorted(starts, firsts))

    def texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        parts: list[tuple[int, str | int]] = []
        for i, text in enumerate(texts):
            for part in self._segments(text):
                parts.append((i, part))
        empty = np.zeros(0, np.uint32)
        gathered: list[np.ndarray] = []
        at = 0
        for start, end in ct.groups([len(p) if isinstance(p, str) else 0 for _, p in parts]):
            plain = [p for _, p in parts[start:end] if isinstance(p, str)]
            ids, counts = self._pieces(plain) if plain else (empty, np.zeros(0, np.int64))
            done = np.append(0, np.cumsum(counts))
            k = 0
            for owner, part in parts[start:end]:
                while at < owner:
                    yield np.concatenate(gathered) if gathered else empty
                    gathered = []
                    at += 1
                if isinstance(part, str):
                    gathered.append(ids[done[k] : done[k + 1]])
                    k += 1
                else:
                    gathered.append(np.array([part], np.uint32))
        while at < len(texts):
            yield np.concatenate(gathered) if gathered else empty
            gathered = []
            at += 1

    def _segments(self, text: str) -> Iterator[str | int]:
        """Plain parts of a text, and the ids of special tokens written in it."""
        for token, i in self.special.items():
            if token in text:
                head, *rest = text.split(token)
                yield from self._segments(head)
                for part in rest:
                    yield i
                    yield from self._segments(part)
                return
        if text:
            yield from safe_chunks(text)


def _byte_offsets(whole: str, codes: np.ndarray):
    """A function from spans of characters to UTF-8 bytes with the starts and sizes of the spans."""
    flat = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
    offset = np.arange(len(codes) + 1)
    if len(flat) > len(codes):
        offset[1:] += np.cumsum((codes > 0x7F).view(np.uint8) + (codes > 0x7FF) + (codes > 0xFFFF), dtype=np.int64)
    return lambda starts, ends: (flat, offset[starts], offset[ends] - offset[starts])


@lru_cache(2)
def segment_tree_encoder(path: str) -> tuple[Encoder, Vocabulary]:
    vocabulary = Vocabulary(path)
    return Encoder(lambda *pieces: encode_pieces(*pieces, vocabulary), vocabulary.special), vocabulary


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    """The text of ids: their bytes in order, with U+FFFD where those are not UTF-8."""
    lengths = vocabulary.token_length[ids]
    return vocabulary.token_bytes[ct.ranges(vocabulary.token_start[ids], lengths)].tobytes().decode("utf-8", "replace")


# ---- Spark --------------------------------------------------------------------------------------


# What `encoded` returns of each text besides its id: columns and how ids become their values.
Projection = tuple[str, Callable[[np.ndarray, Vocabulary], tuple]]

WHOLE: Projection = ("ids array<int>, decoded string", lambda ids, v: (ids.view(np.int32), decode(ids, v)))
DIGESTS: Projection = (
    "n_tokens long, ids_sha256 string, decoded_sha256 string",
    lambda ids, v: (
        len(ids),
        hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
        hashlib.sha256(decode(ids, v).encode()).hexdigest(),
    ),
)


def encoded(
    df: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", projection: Projection = WHOLE
) -> DataFrame:
    """The id of every row, the ids of its text and the text decoded from them.

    A null text counts as empty and has no ids; an empty table gives an empty result; repeated rows
    are encoded each.  Other columns are not read.  `path` is the vocabulary file, present on every
    worker.  `projection` says what of the ids leaves the task: whole, or as `DIGESTS`.
    """
    columns, project = projection
    schema = T.StructType([df.select(F.col(id_column)).schema[0], *T._parse_datatype_string(columns).fields])
    types = to_arrow_schema(schema)

    def work(batches):
        encoder, vocabulary = segment_tree_encoder(path)
        for batch in batches:
            for keys, texts in small_batches(batch):
                rows = [project(ids, vocabulary) for ids in encoder.texts(texts)]
                values = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types.types[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([keys, *values], schema=types)

    return df.select(id_column, text_or_empty(text)).mapInArrow(released(work), schema)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text")


def small_batches(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """The first column and the texts of the second, some 300,000 characters at a time."""
    sizes = pc.binary_length(batch.column(1)).to_pylist()
    for start, end in ct.groups(sizes):
        part = batch.slice(start, end - start)
        yield part.column(0), part.column(1).to_pylist()
