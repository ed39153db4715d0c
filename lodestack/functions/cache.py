"""A bounded memory of recent results."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Hashable
from typing import Any


class RecentResults:
    """Holds up to `size` results, for `seconds` each (None: no limit); the one unused for longest goes first.

    Threads may share it. A result is made outside the lock, so two may make the same at once.
    """

    def __init__(self, size: int, seconds: float | None = None, clock: Callable[[], float] = time.monotonic):
        self.size, self.seconds, self.clock = max(1, size), seconds, clock
        self.held: dict[Hashable, tuple[float, Any]] = {}
        self.guard = threading.RLock()

    def get(self, key: Hashable, otherwise: Any = None) -> Any:
        with self.guard:
            made, value = self.held.pop(key, (None, otherwise))
            if made is None or (self.seconds is not None and self.clock() - made > self.seconds):
                return otherwise
            self.held[key] = made, value  # now the most recent
            return value

    def put(self, key: Hashable, value: Any) -> Any:
        with self.guard:
            self.held.pop(key, None)
            self.held[key] = self.clock(), value
            for oldest in list(self.held)[: len(self.held) - self.size]:
                del self.held[oldest]
        return value

    def of(self, key: Hashable, make: Callable[[], Any]) -> Any:
        missing = object()
        value = self.get(key, missing)
        return self.put(key, make()) if value is missing else value

    def clear(self) -> None:
        with self.guard:
            self.held.clear()

    def __len__(self) -> int:
        return len(self.held)
