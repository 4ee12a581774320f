"""Traces of engine operations: phases that follow each other, none where nobody listens."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

TRACE_SCHEMA = "operation string, sequence long, outcome string, total_ns long, spans array<struct<name: string, duration_ns: long, bytes: long>>"


@dataclass
class Trace:
    """``outcome`` UNKNOWN means success.  Keys and values are never part of a trace."""

    operation: str
    sequence: int = 0
    outcome: str = "UNKNOWN"
    total_ns: int = 0
    spans: list[tuple[str, int, int]] = field(default_factory=list)

    def row(self) -> tuple:
        return self.operation, self.sequence, self.outcome, self.total_ns, self.spans


class Recorder:
    """Times one operation; ``listener`` None records nothing."""

    def __init__(self, operation: str, listener=None, clock=time.perf_counter_ns):
        self.listener, self.clock = listener, clock
        self.trace = Trace(operation) if listener else None
        self.began = self.mark = clock() if listener else 0

    def span(self, name: str, size: int = 0) -> None:
        """What went by since the last span was ``name``."""
        if self.trace is not None:
            now = self.clock()
            self.trace.spans.append((name, now - self.mark, size))
            self.mark = now

    def finish(self, sequence: int = 0, outcome: str = "UNKNOWN") -> None:
        if self.trace is not None:
            self.trace.sequence, self.trace.outcome, self.trace.total_ns = sequence, outcome, self.clock() - self.began
            self.listener(self.trace)
            self.trace = None

    def abandon(self, outcome: str) -> None:
        """An operation whose phases cannot be told: no spans."""
        if self.trace is not None:
            self.trace.spans = []
            self.finish(outcome=outcome)
