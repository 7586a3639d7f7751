"""State of one group, fed event by event: what batch folds and streams share. Times are microseconds."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field
from heapq import heappop, heappush

from .windows import EPOCH

_TESTS = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "eq": lambda a, b: a == b, "neq": lambda a, b: a != b}


@dataclass
class TwoBucket:
    """The estimate of a trailing sum; a late value goes to the current bucket, none of which has passed then."""

    window: int
    start: int | None = None
    before: float = 0.0
    now: float = 0.0

    def add(self, t: int, value: float) -> float:
        bucket = (t + EPOCH) // self.window
        if self.start is None:
            self.start = bucket
        elif bucket > self.start:
            self.before, self.now, self.start = (self.now if bucket == self.start + 1 else 0.0), 0.0, bucket
        passed = max(0, t + EPOCH - self.start * self.window)
        self.now += value
        return self.before * (self.window - passed) / self.window + self.now


@dataclass
class Average:
    window: int
    sums: TwoBucket = None
    counts: TwoBucket = None

    def __post_init__(self) -> None:
        self.sums = self.sums or TwoBucket(self.window)
        self.counts = self.counts or TwoBucket(self.window)

    def add(self, t: int, value: float) -> float:
        total, n = self.sums.add(t, value), self.counts.add(t, 1)
        return total / n if n else 0.0


@dataclass
class Distinct:
    """Different values in [t - window, t]; the heap has an entry for each time that a value was seen last."""

    window: int
    last: dict[str, int] = field(default_factory=dict)
    heap: list = field(default_factory=list)

    def add(self, t: int, value: str) -> float:
        if t > self.last.get(value, t - 1):
            self.last[value] = t
            heappush(self.heap, (t, value))
        while self.heap and self.heap[0][0] < t - self.window:
            at, old = heappop(self.heap)
            if self.last.get(old) == at:
                del self.last[old]
        return float(len(self.last))


@dataclass
class Extremum:
    """The least (sign 1) or greatest (sign -1) value in [t - window, t], by a monotonic queue."""

    window: int
    sign: int
    queue: deque = field(default_factory=deque)

    def add(self, t: int, value: float) -> float:
        while self.queue and self.queue[-1][1] * self.sign >= value * self.sign:
            self.queue.pop()
        self.queue.append((t, value))
        while self.queue[0][0] < t - self.window:
            self.queue.popleft()
        return self.queue[0][1]


@dataclass
class LastSeen:
    """When each search matched last; not longer ago than the window, or at all if that is 0 or less."""

    window: int
    last: dict[str, int] = field(default_factory=dict)

    def see(self, t: int, matched: list[str], names: list[str]) -> dict[str, bool]:
        """Takes one event; which searches are recent."""
        for n in matched:
            self.last[n] = max(t, self.last.get(n, t))
        return {n: n in self.last and (self.window <= 0 or self.last[n] >= t - self.window) for n in names}


def aggregate_fold(func: str, window: int):
    """The fold of an aggregate function; count over a field is `distinct`."""
    if func in ("count", "sum"):
        return TwoBucket(window)
    return {"avg": lambda: Average(window), "distinct": lambda: Distinct(window), "min": lambda: Extremum(window, 1), "max": lambda: Extremum(window, -1)}[func]()


@dataclass
class CorrelationFold:
    """Observations of one bucket in time order; empties when it fires."""

    type: str
    span: int
    references: int
    condition: tuple = ()
    seen: list = field(default_factory=list)  # (time, matched references, value)

    def observe(self, t: int, refs: tuple[int, ...], value: str | None) -> bool:
        """Takes one event; whether it fires."""
        at = len(self.seen)
        while at and self.seen[at - 1][0] > t:
            at -= 1
        self.seen.insert(at, (t, refs, value))
        cutoff = self.seen[-1][0] - self.span
        drop = 0
        while drop < len(self.seen) and self.seen[drop][0] < cutoff:
            drop += 1
        del self.seen[:drop]
        if fired := self._test():
            self.seen.clear()
        return fired

    def _test(self) -> bool:
        if self.type == "temporal":
            return len({r for _, refs, _ in self.seen for r in refs}) == self.references
        if self.type == "temporal_ordered":
            step = 0
            for _, refs, _ in self.seen:
                if step < self.references and step in refs:
                    step += 1
            return step == self.references
        n = len(self.seen) if self.type == "event_count" else len({v for _, _, v in self.seen if v is not None})
        return all(_TESTS[op](n, x) for op, x in self.condition)
