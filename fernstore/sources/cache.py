"""A bounded cache of stores' documents: persisted DataFrames, evicted by policy."""

from __future__ import annotations

import time
from collections.abc import Callable, Hashable
from dataclasses import dataclass

from pyspark.sql import DataFrame

POLICIES = ("LRU", "LFU", "FIFO")


@dataclass
class Entry:
    state: Hashable
    df: DataFrame
    made: float
    used: float
    uses: int = 0


class Cache:
    """Up to ``size`` stores; the least recently used, least often used or oldest goes first, and any after ``ttl`` seconds."""

    def __init__(self, load: Callable[[str], DataFrame], size: int = 16, policy: str = "LRU", ttl: float | None = None, clock: Callable[[], float] = time.monotonic):
        if policy not in POLICIES:
            raise ValueError(f"unknown policy {policy!r}; one of {', '.join(POLICIES)}")
        self.load, self.size, self.policy, self.ttl, self.clock = load, size, policy, ttl, clock
        self.entries: dict[str, Entry] = {}
        self.hits = self.misses = self.evictions = 0

    def get(self, name: str, state: Hashable) -> DataFrame:
        """What is kept for ``name`` if it was made in this state, else it is loaded and kept."""
        now = self.clock()
        for old in [n for n, e in self.entries.items() if self.ttl is not None and now - e.made > self.ttl or n == name and e.state != state]:
            self.drop(old)
        entry = self.entries.get(name)
        if entry is None:
            self.misses += 1
            while len(self.entries) >= max(1, self.size):
                self.drop(min(self.entries, key=self._worth))
                self.evictions += 1
            entry = self.entries[name] = Entry(state, self.load(name).persist(), now, now)
        else:
            self.hits += 1
        entry.used, entry.uses = now, entry.uses + 1
        return entry.df

    def _worth(self, name: str) -> tuple:
        e = self.entries[name]
        return {"LRU": (e.used,), "LFU": (e.uses, e.used), "FIFO": (e.made,)}[self.policy]

    def drop(self, name: str) -> None:
        entry = self.entries.pop(name, None)
        if entry is not None:
            entry.df.unpersist()

    def clear(self) -> None:
        for name in list(self.entries):
            self.drop(name)

    def stats(self) -> dict[str, int]:
        return {"entries": len(self.entries), "hits": self.hits, "misses": self.misses, "evictions": self.evictions}
