"""Words to numbers and to runs of ids, remembered within a worker, for all that works on one word at a time."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

#: So many distinct words, or characters of words, are remembered at most; then a worker begins anew.
REMEMBERED, CHARACTERS = 800_000, 24_000_000


class Numbers(dict):
    """Gives each new word the next number; names lists the words by number."""

    def __init__(self) -> None:
        super().__init__()
        self.names: list = []

    def __missing__(self, word) -> int:
        self[word] = number = len(self.names)
        self.names.append(word)
        return number

    def of(self, words: list[list]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))


class WordTable:
    """The ids of words one after another, each word encoded once. encode: new words to (all ids, ids of each word)."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype: np.dtype) -> None:
        self.encode, self.dtype = encode, dtype
        self.clear()

    def clear(self) -> None:
        self.numbers, self.characters = Numbers(), 0
        self.ids, self.sizes, self.starts = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all words in a row: their ids, and of each word its number and how many ids it has."""
        if len(self.sizes) > REMEMBERED or self.characters > CHARACTERS:
            self.clear()
        at = self.numbers.of(words)
        if new := self.numbers.names[len(self.sizes) :]:
            ids, sizes = self.encode(new)
            self.characters += sum(map(len, new))
            self.ids, self.sizes = np.concatenate([self.ids, ids.astype(self.dtype)]), np.concatenate([self.sizes, sizes])
            self.starts = np.cumsum(self.sizes) - self.sizes
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(total)], at, sizes


def by_text(ids: np.ndarray, sizes: np.ndarray, words: list[list[str]]) -> list[np.ndarray]:
    """Ids of each text from the ids of all words in a row."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    cuts = upto[np.cumsum([0, *map(len, words)])].tolist()
    return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
