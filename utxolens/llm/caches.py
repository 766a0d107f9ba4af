"""Bounded caches for values that repeat in a text corpus."""

from __future__ import annotations

from collections.abc import Callable, Hashable


class TwoGenerations(dict):
    """``make(key)`` for keys looked up by ``cache[key]``, kept in bounded memory.

    When the younger generation is full it becomes the older one, and the older one is
    given up. A key that is asked for again moves to the younger one, so frequent keys
    are never made anew, and a lookup of a young key is a plain dictionary access.
    """

    def __init__(self, make: Callable[[Hashable], object], limit: int, longest: int = 48):
        super().__init__()
        self._make, self._limit, self._longest = make, limit, longest
        self._older: dict = {}

    def forget(self) -> None:
        self.clear()
        self._older = {}

    def __missing__(self, key):
        found = self._older.get(key)
        if found is None:
            found = self._make(key)
            if len(key) > self._longest:
                return found
        if len(self) >= self._limit:
            self._older = dict(self)
            self.clear()
        self[key] = found
        return found
