"""Timed runs of probes: a warm-up over all of them, a timed pass, the correctness tail, and campaigns of three repetitions.

Timing is the driver's by nature: one probe after the other is one action each. What is timed is only the action that brings the
result; its digest is taken after the clock has stopped. Samples go to an artifact by ``sources.records`` and into
``operators.repetitions``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Probe:
    operation: str
    sequence: int
    stratum: str
    measured: bool
    key: Any


@dataclass(frozen=True)
class Sample:
    operation: str
    sequence: int
    stratum: str
    wall_seconds: float
    correctness_status: str
    actual_cardinality: int | None = None
    actual_digest: str | None = None
    error: str | None = None


@dataclass
class Pass:
    operation: str
    repetition: int
    correctness: str
    samples: list[Sample] = field(default_factory=list)
    seconds: float | None = None
    failed_in: str | None = None
    error: str | None = None


def timed(
    operation: str, repetition: int, probes: Sequence[Probe], expected: dict[tuple[str, int], tuple[int, str]],
    run: Callable[[Probe], Any], digest: Callable[[Probe, Any], tuple[int, str]], clock: Callable[[], float] = time.perf_counter,
) -> Pass:
    """One pass of an operation. ``run`` brings a probe's whole result, ``digest`` its cardinality and digest.

    A warm-up that is not valid, or an error, ends it: an error's sample is the last one. The tail of unmeasured probes is
    checked after a whole pass, untimed."""
    own = sorted((p for p in probes if p.operation == operation), key=lambda p: p.sequence)
    measured, tail = [p for p in own if p.measured], [p for p in own if not p.measured]

    def check(these: list[Probe]) -> tuple[str, str | None]:
        status = "VALID"
        for p in these:
            try:
                if digest(p, run(p)) != expected[p.operation, p.sequence]:
                    status = "INVALID"
            except Exception as e:  # noqa: BLE001  whatever a candidate raises is its error
                return "ERROR", str(e)
        return status, None

    status, error = check(measured)
    if status != "VALID":
        return Pass(operation, repetition, status, failed_in="warmup" if error else None, error=error)
    out, began = Pass(operation, repetition, "VALID"), clock()
    for p in measured:
        start = clock()
        try:
            result, error = run(p), None
        except Exception as e:  # noqa: BLE001
            result, error = None, str(e)
        wall = clock() - start
        if error is None:
            try:
                found = digest(p, result)
            except Exception as e:  # noqa: BLE001
                error = str(e)
        if error is not None:
            out.samples.append(Sample(operation, p.sequence, p.stratum, wall, "ERROR", error=error))
            out.correctness, out.failed_in, out.error = "ERROR", "timed-probe", error
            break
        good = found == expected[p.operation, p.sequence]
        out.samples.append(Sample(operation, p.sequence, p.stratum, wall, "VALID" if good else "INVALID", *found))
        out.correctness = out.correctness if good else "INVALID"
    out.seconds = clock() - began if measured else None
    if out.failed_in is None and tail:
        status, error = check(tail)
        if status == "ERROR":
            out.correctness, out.failed_in, out.error = "ERROR", "tail", error
        elif status == "INVALID":
            out.correctness = "INVALID"
    return out


def campaign(operations: Sequence[str], one: Callable[[str, int], Pass], sound: Callable[[Pass], bool], repetitions: Sequence[int] = (1, 2, 3)) -> tuple[list[Pass], list[tuple[str, int]]]:
    """Runs every operation in every repetition, in order. A pass whose evidence is not sound halts the campaign: what would
    have come after it is returned as not attempted."""
    order = [(op, r) for r in repetitions for op in operations]
    done: list[Pass] = []
    for i, (op, r) in enumerate(order):
        done.append(one(op, r))
        if not sound(done[-1]):
            return done, order[i + 1 :]
    return done, []
