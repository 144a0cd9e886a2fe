"""Whole texts as flat arrays of code points, for vectorised work inside tasks.

Every helper takes the texts of one Arrow batch and works on all their characters at once, so the
cost per character is a few array passes and never a Python loop.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

# Characters handled at once; a longer text is taken in pieces where the caller can cut it.
CHUNK_CHARS = 300_000

# The code points with the Unicode property White_Space.
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
ASCII_SPACE = (*range(0x09, 0x0E), 0x20)

# Slices above this length are hashed as a whole.
LONG_SLICE = 96

_SEED, _FEED = np.uint64(0x9E3779B97F4A7C13), np.uint64(0xD6E8FEB86659FD93)
# The bits of one, two and three characters.
_FILLED = np.array([0, (1 << 21) - 1, (1 << 42) - 1, (1 << 63) - 1], np.uint64)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def groups(sizes: list[int], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `limit` characters together, at least one text each."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    _scramble(x)
    return x


def _scramble(x: np.ndarray) -> None:
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)


def slice_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of `codes`, equal for equal slices.

    Slices of up to `LONG_SLICE` characters are folded three characters (63 bits) at a time; each
    fold scrambles the state and adds the characters once more, so that it cannot be run backwards
    and differences do not cancel as they do in a sum of powers.  Longer slices are digested whole.
    Different slices share a hash with the chance of 64 random bits; users that must not err compare
    the characters as well.
    """
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) + _SEED)
    short = np.flatnonzero((sizes <= LONG_SLICE) & (sizes > 0))
    short = short[np.argsort(-sizes[short].astype(np.int16), kind="stable")]
    # Every place with the two characters after it.
    following = np.zeros(len(codes) + 2, np.uint64)
    following[:-2] = codes
    left, at, state = sizes[short], starts[short], out[short]
    while len(at):
        x = following[at + 2]
        x <<= np.uint64(21)
        x |= following[at + 1]
        x <<= np.uint64(21)
        x |= following[at]
        x &= _FILLED[np.minimum(left, 3)]
        now = state[: len(at)]
        now ^= x
        _scramble(now)
        x *= _FEED
        now += x
        # The slices are in falling order of size, so those that go on come first.
        more = int(np.searchsorted(-left, -3, side="left"))
        at, left = at[:more] + 3, left[:more] - 3
    out[short] = state
    for i in np.flatnonzero(sizes > LONG_SLICE):
        whole = hashlib.blake2b(codes[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = np.frombuffer(whole, np.uint64)[0]
    return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of every (start, count), one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)


def spans(mask: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values, cut at text edges, and the text of each.

    Text i covers `edges[i]` to `edges[i + 1]`.
    """
    if not len(mask):
        none = np.zeros(0, np.int64)
        return none, none, none
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    begin = edges[:-1][np.diff(edges) > 0]
    first[begin] = mask[begin]
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(mask))
    filled = np.append(0, np.cumsum(mask))
    ends = starts + (filled[ends] - filled[starts])
    return starts, ends, np.searchsorted(edges, starts, side="right") - 1
