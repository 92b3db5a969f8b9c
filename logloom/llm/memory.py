"""A worker's memory of repeated units and what they are encoded to."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa

_kept: list = []


def kept_by_worker(make: Callable) -> Callable:
    """``make``, whose last two results a worker process keeps for its later tasks, until ``forget``."""
    cached = lru_cache(maxsize=2)(make)
    _kept.append(cached)
    return cached


def forget() -> None:
    """Drop what this worker process keeps for tasks of other operators: Spark uses a process for one after the other."""
    for cached in _kept:
        cached.cache_clear()
    trim()


def trim() -> None:
    """Give the memory that this worker process has freed, but still holds, back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


class Memory:
    """Looks units up, and encodes those that are new.

    Two generations of up to ``size`` units: when the younger is full it becomes the
    older, whose units are forgotten unless they were met again.
    """

    def __init__(self, encode: Callable[[list[str]], list], size: int, longest: int = 64):
        self.encode, self.size, self.longest = encode, size, longest
        self.young: dict = {}
        self.old: dict = {}

    def all(self, units: list[str]) -> list:
        """What every one of ``units`` is encoded to."""
        found = list(map(self.young.get, units))
        new = [n for n, f in enumerate(found) if f is None]
        if new:
            for n, entry in zip(new, self._learn([units[n] for n in new])):
                found[n] = entry
        return found

    def _learn(self, units: list[str]) -> list:
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        found = list(map(self.old.get, units))
        new = [n for n, f in enumerate(found) if f is None]
        for n, entry in zip(new, self.encode([units[n] for n in new])):
            found[n] = entry
        self.young.update([(u, e) for u, e in zip(units, found) if len(u) <= self.longest])
        return found
