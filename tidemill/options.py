"""Declared bounds and policies. Values are checked where a stage is placed, and the error names the parameter."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import StrEnum


class OverflowPolicy(StrEnum):
    BACKPRESSURE = "backpressure"
    DROP_OLDEST = "drop-oldest"
    DROP_NEWEST = "drop-newest"
    DROP_BUFFER = "drop-buffer"
    FAIL = "fail"


class KeyOverflowPolicy(StrEnum):
    FAIL = "fail"
    EVICT_OLDEST = "evict-oldest"


class ActiveKeyOverflowPolicy(StrEnum):
    FAIL = "fail"
    EVICT_IDLE = "evict-idle"


class ThrottleMode(StrEnum):
    SHAPING = "shaping"
    ENFORCING = "enforcing"


class SupervisionForm(StrEnum):
    RESUME = "resume"
    RESTART_STAGE = "restart-stage"
    RETRY = "retry"
    RECOVER = "recover"


class RetryExhaustion(StrEnum):
    FAIL = "fail"
    RESUME = "resume"
    RESTART_STAGE = "restart-stage"


class ValveMode(StrEnum):
    OPEN = "open"
    CLOSED = "closed"


def at_least(name: str, value: int, least: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ValueError(f"{name} must be a whole number of at least {least}, not {value!r}")
    return value


def positive(name: str, micros: int) -> int:
    """Durations are whole microseconds."""
    return at_least(name, micros, 1)


@dataclass(frozen=True)
class BufferOptions:
    capacity: int
    overflow_policy: OverflowPolicy = OverflowPolicy.BACKPRESSURE

    def check(self) -> None:
        at_least("capacity", self.capacity, 1)
        OverflowPolicy(self.overflow_policy)


@dataclass(frozen=True)
class ParallelismOptions:
    max_concurrency: int

    def check(self) -> None:
        at_least("max_concurrency", self.max_concurrency, 1)


@dataclass(frozen=True)
class CollectOptions:
    max_elements: int

    def check(self) -> None:
        at_least("max_elements", self.max_elements, 1)


@dataclass(frozen=True)
class DistinctOptions:
    max_tracked_keys: int
    overflow_policy: KeyOverflowPolicy = KeyOverflowPolicy.FAIL

    def check(self) -> None:
        at_least("max_tracked_keys", self.max_tracked_keys, 1)
        KeyOverflowPolicy(self.overflow_policy)


@dataclass(frozen=True)
class GroupByOptions:
    max_active_keys: int
    overflow_policy: ActiveKeyOverflowPolicy = ActiveKeyOverflowPolicy.FAIL

    def check(self) -> None:
        at_least("max_active_keys", self.max_active_keys, 1)
        ActiveKeyOverflowPolicy(self.overflow_policy)


@dataclass(frozen=True)
class ThrottleOptions:
    elements: int
    per_micros: int
    maximum_burst: int | None = None
    mode: ThrottleMode = ThrottleMode.SHAPING

    @property
    def burst(self) -> int:
        return self.elements if self.maximum_burst is None else self.maximum_burst

    def check(self) -> None:
        at_least("elements", self.elements, 1)
        positive("per_micros", self.per_micros)
        if self.maximum_burst is not None:
            at_least("maximum_burst", self.maximum_burst, 1)
        ThrottleMode(self.mode)


@dataclass(frozen=True)
class SupervisionOptions:
    form: SupervisionForm
    max_attempts: int = 1
    backoff_micros: tuple[int, ...] = field(default=())
    on_exhaustion: RetryExhaustion = RetryExhaustion.FAIL

    def check(self) -> None:
        SupervisionForm(self.form), RetryExhaustion(self.on_exhaustion)
        at_least("max_attempts", self.max_attempts, 1)
        for rung in self.backoff_micros:
            at_least("backoff_micros", rung, 0)
        if self.form != SupervisionForm.RETRY and (self.max_attempts != 1 or self.backoff_micros or self.on_exhaustion != RetryExhaustion.FAIL):
            raise ValueError("max_attempts, backoff_micros and on_exhaustion are for the retry form only")


@dataclass(frozen=True)
class DurableRunOptions:
    """A durable run: where its checkpoints live, its name, and how much is admitted between two of them."""

    location: str
    run_id: str
    every_elements: int | None = None
    interval_micros: int | None = None

    def check(self) -> None:
        if self.every_elements is not None:
            at_least("every_elements", self.every_elements, 1)
        if self.interval_micros is not None:
            positive("interval_micros", self.interval_micros)
