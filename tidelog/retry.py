"""Retrying with exponential back-off, reconnecting with a linear one."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.errors import Cancelled, ConnectionFailed, InvalidArgument, KeyNotFound, NetworkFailed, ReadOnly, ServerError

JITTER = 0.25


@dataclass(frozen=True)
class Backoff:
    """Delay before try n+1 in ms: ``base * 2^n``, at most ``cap`` (0: no cap), then up to 25 % more or less."""

    attempts: int = 3
    base_ms: int = 100
    cap_ms: int = 5000
    jitter: bool = True

    def delay_ms(self, attempt: int, rng: random.Random | None = None) -> float:
        if self.attempts <= 0 or attempt < 0:
            return 0
        delay = self.base_ms * 2**attempt
        if self.cap_ms:
            delay = min(delay, self.cap_ms)
        return delay * (1 + (rng or random).uniform(-JITTER, JITTER)) if self.jitter else delay


def retryable(error: BaseException) -> bool:
    """Connection trouble is worth another try, also when it wraps a cancellation; refusals are not; unknown errors are."""
    if isinstance(error, (ConnectionFailed, NetworkFailed)):
        return True
    return not isinstance(error, (ServerError, KeyNotFound, InvalidArgument, Cancelled))


def retry[T](work: Callable[[], T], backoff: Backoff = Backoff(), sleep: Callable[[float], None] = time.sleep) -> T:
    """The result of the first try that succeeds, of ``attempts + 1`` at most; else the last error."""
    for attempt in range(max(0, backoff.attempts) + 1):
        try:
            return work()
        except Exception as e:
            if attempt >= backoff.attempts or not retryable(e):
                raise
            sleep(backoff.delay_ms(attempt) / 1000)
    raise AssertionError("unreachable")


@dataclass(frozen=True)
class LinearBackoff:
    """Reconnecting to a master: so many attempts, ``attempt * base`` between one and the next, no jitter."""

    attempts: int = 5
    base_ms: int = 1000

    def delay_ms(self, attempt: int) -> int:
        """The wait after the attempt with this number, counted from 1; none after the last."""
        return attempt * self.base_ms if 1 <= attempt < self.attempts else 0


def connect[T](work: Callable[[], T], backoff: LinearBackoff = LinearBackoff(), sleep: Callable[[float], None] = time.sleep, on: tuple[type[BaseException], ...] = (Exception,)) -> T:
    """The result of the first attempt that succeeds; ``ConnectionFailed`` after the last. A cancellation ends it at once."""
    for attempt in range(1, backoff.attempts + 1):
        try:
            return work()
        except Cancelled:
            raise
        except on as e:
            last = e
            if attempt < backoff.attempts:
                sleep(backoff.delay_ms(attempt) / 1000)
    raise ConnectionFailed(f"failed to connect to master after {backoff.attempts} attempts") from last


def linear_delay_column(attempt: Column, attempts: int = 5, base_ms: int = 1000) -> Column:
    """The linear schedule as a column."""
    return F.when((attempt >= 1) & (attempt < attempts), attempt * base_ms).otherwise(0).cast("bigint")


def verdict(reply: Column) -> Column:
    """What a sender makes of a reply: ``done`` for OK, ``retry`` if none came (the network's fault), ``give up`` if the other side refused."""
    return F.when(reply.isNull(), F.lit("retry")).when(reply == "OK", F.lit("done")).otherwise(F.lit("give up"))


def retryable_column(kind: Column) -> Column:
    """``retryable`` for the ``code`` of an error; null for no error."""
    never = [c.code for c in (ServerError, ReadOnly, KeyNotFound, InvalidArgument, Cancelled)]
    return F.when(kind.isNotNull(), ~kind.isin(*never))


def delay_column(attempt: Column, base_ms: int = 100, cap_ms: int = 5000) -> Column:
    """The schedule without jitter, as a column."""
    delay = F.lit(base_ms).cast("bigint") * F.pow(F.lit(2.0), attempt).cast("bigint")
    return F.least(delay, F.lit(cap_ms).cast("bigint")) if cap_ms else delay
