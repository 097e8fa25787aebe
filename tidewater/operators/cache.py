"""Results of searches, kept on the driver for a while."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable


class ResultCache:
    """Entries live ttl seconds; beyond size entries the one not used for longest goes. The generation of the index
    is part of every key, so a new generation finds nothing old."""

    def __init__(self, ttl: float = 60, size: int = 1000, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.size, self.clock = ttl, size, clock
        self.entries: OrderedDict[tuple, tuple[float, object]] = OrderedDict()

    def get(self, generation: int, *key):
        found = self.entries.get((generation, *key))
        if found is None:
            return None
        if self.clock() >= found[0]:
            del self.entries[(generation, *key)]
            return None
        self.entries.move_to_end((generation, *key))
        return found[1]

    def set(self, value, generation: int, *key) -> None:
        self.entries[(generation, *key)] = (self.clock() + self.ttl, value)
        self.entries.move_to_end((generation, *key))
        while len(self.entries) > self.size:
            self.entries.popitem(last=False)

    def clear(self) -> None:
        self.entries.clear()
