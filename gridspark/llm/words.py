"""Words worked out once: what each different word of a batch, or of many batches, becomes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Words that a worker keeps, and their characters in all; the table is emptied between two batches when it has more.
KEPT, KEPT_CHARS = 400_000, 8_000_000


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of ``counts`` successive values."""
    out, some = np.zeros(len(counts), values.dtype), counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


def expanded(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Elements of the runs of ``flat`` that ``codes`` name, one run after the other; run ``i`` has ``sizes[i]`` elements."""
    starts, many = np.cumsum(sizes) - sizes, sizes[codes]
    ends = np.cumsum(many)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[codes] - ends + many, many)]


class Words(dict):
    """Codes of words in order of first sight; ``work`` gives what new words become, with one row a word in each array.

    The first of the arrays of ``work`` has identifiers, the second the number of each word's; any more are kept as
    ``facts``.
    """

    def __init__(self, work: Callable[[list[str]], tuple[np.ndarray, ...]]) -> None:
        self.work = work
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.chars, self.fresh = 0, []
        self.flat, self.sizes, *self.facts = self.work([])

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        self.fresh.append(word)
        return code

    def codes(self, words: list[str]) -> np.ndarray:
        """Code of each word; the codes hold until the next call."""
        if len(self) > KEPT or self.chars > KEPT_CHARS:
            self.forget()
        found = np.fromiter(map(self.__getitem__, words), np.int64)
        if self.fresh:
            self.chars += sum(map(len, self.fresh))
            self.flat, self.sizes, *self.facts = (np.concatenate(pair) for pair in zip((self.flat, self.sizes, *self.facts), self.work(self.fresh), strict=True))
            self.fresh = []
        return found
