"""Time budgets inside a task: work on one page or one document that takes too long ends, its neighbours go on."""

from __future__ import annotations

import signal
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager


class OutOfTime(Exception):
    """The work's time is over; the class of a record, not an error of the job."""


@contextmanager
def within(milliseconds: float | None) -> Iterator[None]:
    """Raise ``OutOfTime`` in the block once its time is over; None is no limit.

    A timer interrupts the worker's main thread, so loops that never return end too. Budgets nest: the inner
    block's end restores what the outer one has left. Off the main thread, where no timer
    reaches, the time is looked at when the block ends.
    """
    if milliseconds is None:
        yield
        return
    begun, seconds = time.monotonic(), milliseconds / 1000
    if seconds <= 0:
        raise OutOfTime
    if threading.current_thread() is not threading.main_thread():
        yield
        if time.monotonic() - begun > seconds:
            raise OutOfTime
        return

    def ring(*_) -> None:
        raise OutOfTime

    before = signal.signal(signal.SIGALRM, ring)
    left, _ = signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)
        if left:
            signal.setitimer(signal.ITIMER_REAL, max(left - (time.monotonic() - begun), 1e-3))
