"""Ids of whole texts by their words.

Most words of a text have been seen before, and a word is encoded alike wherever
it stands, so every worker keeps the ids of the words it has met. The new words
of a batch go through an encoder together.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

#: Words a worker remembers before it starts afresh; bounds memory, not results.
MOST_WORDS = 250_000


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    made = Tokenizer.from_file(path)
    made.no_padding()
    made.no_truncation()
    return made


class _Numbers(dict):
    """Numbers new words in the order they come, and lists them."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the given ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class WordMemory:
    """Encodes texts by remembered words.

    ``split`` cuts a text into words; ``encode`` gives, for a list of words, how
    many ids each has and all ids one after the other.
    """

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.split, self.encode = split, encode
        self._forget()

    def _forget(self):
        self.numbers = _Numbers()
        self.starts, self.lengths, self.ids, self.filled = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(8192, np.uint32), 0

    def _learn(self):
        new = self.numbers.new
        if not new:
            return
        lengths, flat = self.encode(new)
        first = len(self.numbers) - len(new)
        while len(self.numbers) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        while self.filled + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.lengths[first:len(self.numbers)] = lengths
        self.starts[first:len(self.numbers)] = self.filled + np.cumsum(lengths) - lengths
        self.ids[self.filled:self.filled + len(flat)] = flat
        self.filled += len(flat)
        self.numbers.new = []

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as uint32."""
        if len(self.numbers) > MOST_WORDS:
            self._forget()
        number = self.numbers.__getitem__
        coded = [np.array(list(map(number, words)), np.int64) for words in map(self.split, texts)]
        self._learn()
        return [self.ids[ranges(self.starts[c], self.lengths[c])] for c in coded]


def public_path(name: str) -> str:
    return public_tokenizers.path(name)
