"""A bounded memory of results by word, for Python workers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress


class Memo:
    """word -> result, made in lists by `make`; holds at most twice `limit` words, the last used among them, and words of over `longest` characters only until the next call."""

    def __init__(self, make: Callable[[list[str]], list], limit: int = 400_000, longest: int | None = None):
        self.make, self.limit, self.longest, self.young, self.old, self.passing = make, limit, longest, {}, {}, []

    def learn(self, words: list[str]) -> dict:
        """A dictionary that holds at least these words, valid until the next call."""
        for w in self.passing:
            self.young.pop(w, None)
        missing = set(words).difference(self.young)
        if len(self.young) + len(missing) > self.limit:
            self.old, self.young = self.young, {}
            missing = set(words)
        if missing:
            old = self.old
            new = [w for w in missing if w not in old]
            self.young.update((w, old[w]) for w in missing if w in old)
            self.young.update(zip(new, self.make(new), strict=True))
        self.passing = [w for w in missing if len(w) > self.longest] if self.longest else []
        return self.young


@contextmanager
def uncollected() -> Iterator[None]:
    """Without the cycle collector, which would look through all that is remembered again and again: words and what they give hold no cycles."""
    gc.disable()
    try:
        yield
    finally:
        gc.freeze()
        gc.enable()


_HELD: dict = {}


def held(key: object, make: Callable[[], object]) -> object:
    """What make() gave for this key. A worker keeps one such thing at a time: workers go on from one operator to the next, and what each remembers would add up."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """Freed memory goes back to the system."""
    gc.collect()
    with suppress(AttributeError, OSError):  # glibc keeps freed memory until asked
        ctypes.CDLL(None).malloc_trim(0)


def sliced(batches: Iterator, rows: int = 256, *, key: object = None) -> Iterator:
    """The batches in slices of few rows, so that only their texts are Python objects at a time. What the worker holds under another key is dropped first."""
    gc.unfreeze()  # for what an earlier task left
    if _HELD and key not in _HELD:
        _HELD.clear()
        give_back()
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
