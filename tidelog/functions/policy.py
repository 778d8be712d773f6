"""Failure classes and bounded retries with jittered exponential backoff."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import Conflict

TRANSIENT, PERMANENT, UNKNOWN = "transient", "permanent", "unknown"
# The error codes of the classes.
TRANSIENT_CODES = ("ConditionalCheckFailed", "TransactionConflict", "ProvisionedThroughputExceeded", "ThrottlingError", "RaceCondition")
PERMANENT_CODES = ("ValidationError", "AccessDenied")


class Classified(Exception):
    def __init__(self, kind: str, error: Exception):
        super().__init__(str(error))
        self.kind, self.error = kind, error


def class_of_code(code: Column) -> Column:
    """Class of an error code; transient wins, no code is unknown."""
    return F.when(code.isin(*TRANSIENT_CODES), TRANSIENT).when(code.isin(*PERMANENT_CODES), PERMANENT).otherwise(UNKNOWN)


def class_of_codes(codes: Column) -> Column:
    """Class of a list of codes: transient if any is, else permanent if any is."""
    some = lambda known: F.exists(F.coalesce(codes, F.array()), lambda c: c.isin(*known))
    return F.when(some(TRANSIENT_CODES), TRANSIENT).when(some(PERMANENT_CODES), PERMANENT).otherwise(UNKNOWN)


def classify(error: Exception | None) -> str:
    """A conflicting append is transient: the caller reloads and tries again."""
    if isinstance(error, Classified):
        return error.kind
    return TRANSIENT if isinstance(error, Conflict) else UNKNOWN


def backoff_ms(base: Column, most: Column, attempt: Column) -> Column:
    """Delay before attempt + 1 without jitter: half of base doubled ``attempt`` times, at most ``most``. Not positive: base 1
    millisecond, most as base."""
    base = F.when(base <= 0, 1).otherwise(base)
    most = F.when(most <= 0, base).otherwise(most)
    full = F.least(base.cast("double") * F.pow(F.lit(2.0), F.least(attempt, F.lit(62))), most.cast("double")).cast("long")
    return F.when(full < 2, full).otherwise((full / 2).cast("long"))


def delay(base: float, most: float, attempt: int, jitter: Callable[[float], float] | None = random.random) -> float:
    """Seconds before the next attempt: between half and all of the doubled base."""
    base = base if base > 0 else 0.001
    full = min(base * 2 ** min(attempt, 62), most if most > 0 else base)
    part = 0.0 if jitter is None else min(1.0, max(0.0, jitter()))
    return full / 2 + part * full / 2


@dataclass
class Retry:
    """Bounded retries of what ``retryable`` says, else of transient errors."""

    attempts: int = 5
    base: float = 0.1
    most: float = 2.0
    jitter: Callable[[], float] | None = random.random
    classify: Callable[[Exception], str] = classify
    retryable: Callable[[Exception], bool] | None = None
    sleep: Callable[[float], None] = time.sleep
    on_retry: Callable[[int, float, Exception], None] | None = None
    on_give_up: Callable[[int, Exception], None] | None = None

    def run(self, op: Callable[[], Any]) -> Any:
        attempt = 0
        while True:
            attempt += 1
            try:
                return op()
            except Exception as e:  # noqa: BLE001
                kind = self.classify(e)
                again = self.retryable(e) if self.retryable else kind == TRANSIENT
                if attempt >= max(1, self.attempts) or not again:
                    if self.on_give_up:
                        self.on_give_up(attempt, e)
                    raise Classified(kind, e) from e
                wait = delay(self.base, self.most, attempt - 1, self.jitter)
                if self.on_retry:
                    self.on_retry(attempt, wait, e)
                self.sleep(wait)
