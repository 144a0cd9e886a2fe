"""Words and character counts of many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from orderlens.llm import chartext as ct
from orderlens.llm.bpe import LETTER, NUMBER, OTHER, SPACE, character_classes


@lru_cache(1)
def lower_table() -> np.ndarray:
    """The lower-case form of every code point, where that is one code point."""
    table = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        low = chr(i).lower()
        if len(low) == 1:
            table[i] = ord(low)
    return table


@lru_cache(1)
def upper_flags() -> np.ndarray:
    return lower_table() != np.arange(0x110000, dtype=np.uint32)


class Texts:
    """A list of texts as flat arrays.

    `owner[k]` is the text of token k; tokens are the runs without white space, `starts` and `ends`
    their places in `codes`.
    """

    def __init__(self, texts: list[str]):
        self.codes = ct.codes_of("".join(texts))
        self.n = len(texts)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.edges = np.append(0, np.cumsum(self.sizes))
        self.kind = character_classes()[self.codes]
        self.lower = lower_table()[self.codes]
        self.starts, self.ends, self.owner = self.spans(self.kind != SPACE)

    def spans(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of true characters, cut where a text ends; with the text of each."""
        return ct.spans(mask, self.edges)

    def count(self, mask: np.ndarray) -> np.ndarray:
        """True characters of each text."""
        total = np.append(0, np.cumsum(mask, dtype=np.int64))
        return total[self.edges[1:]] - total[self.edges[:-1]]

    def per_text(self, owner: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(owner, weights, minlength=self.n).astype(float)

    def shape(self) -> np.ndarray:
        """Counts of characters by kind: letters, digits, others, upper case, exclamation marks,
        line ends, white space."""
        return np.stack(
            [
                self.count(self.kind == LETTER),
                self.count(self.kind == NUMBER),
                self.count(self.kind == OTHER),
                self.count(upper_flags()[self.codes]),
                self.count((self.codes == 0x21) | (self.codes == 0xA1)),
                self.count(self.codes == 0x0A),
                self.count(self.kind == SPACE),
            ],
            axis=1,
        ).astype(float)


def ratio(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1.0)
