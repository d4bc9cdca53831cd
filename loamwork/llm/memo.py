"""A bounded two-generation memo for per-word work inside a Python worker."""

from __future__ import annotations

from collections.abc import Callable


class Memo(dict):
    """word -> compute(word), remembered for at most 2 * half words.

    When the young generation is full it becomes the old one, so frequent words survive and memory
    stays bounded however many distinct words a worker meets.  Long words are never remembered.
    """

    def __init__(self, compute: Callable, half: int = 300_000, longest: int = 48):
        super().__init__()
        self._compute, self._half, self._longest, self._old = compute, half, longest, {}

    def __missing__(self, word):
        value = self._old.get(word)
        if value is None:
            value = self._compute(word)
            if len(word) > self._longest:
                return value
        if len(self) >= self._half:
            self._old = dict(self)
            self.clear()
        self[word] = value
        return value
