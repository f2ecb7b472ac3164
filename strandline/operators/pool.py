"""A bounded pool of workers that are dear to make, such as recognisers."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from strandline.errors import EngineError


class Pool:
    """At most ``size`` workers; a caller waits for one that is given back, or leaves when its work is cancelled.

    A worker that can't be made doesn't count as made, and whoever waits at that time is told.
    """

    def __init__(self, size: int, make: Callable[[], object], close: Callable[[object], None] = lambda worker: None) -> None:
        self.size, self.make, self.close = size, make, close
        self.made, self.idle, self._turn = 0, deque(), threading.Condition()
        self._failed: tuple[int, Exception] | None = None
        self._failures = 0

    def acquire(self, stop: threading.Event | None = None) -> object:
        with self._turn:
            seen = self._failures
            while True:
                if stop is not None and stop.is_set():
                    raise EngineError("CANCELLED", "cancelled while waiting for a worker")
                if self._failures > seen:
                    raise self._failed[1]
                if self.idle:
                    return self.idle.popleft()
                if self.made < self.size:
                    self.made += 1
                    break
                self._turn.wait(0.05)
        try:
            return self.make()
        except Exception as e:
            with self._turn:
                self.made -= 1
                self._failures += 1
                self._failed = (self._failures, e)
                self._turn.notify_all()
            raise

    def release(self, worker: object) -> None:
        with self._turn:
            self.idle.append(worker)
            self._turn.notify()

    @contextmanager
    def worker(self, stop: threading.Event | None = None) -> Iterator[object]:
        one = self.acquire(stop)
        try:
            yield one
        finally:
            self.release(one)

    def terminate(self) -> None:
        """Closes the workers that are not in use and forgets the others."""
        with self._turn:
            for worker in self.idle:
                self.close(worker)
            self.idle.clear()
            self.made = 0
