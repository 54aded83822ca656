"""A limit on the time that a worker spends on one document."""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable


class Overdue(TimeoutError):
    """A document took longer than its deadline."""


def limited(seconds: float, f: Callable, *args):
    """f(*args), or Overdue after so many seconds. In a worker's main thread, where user code runs, a timer interrupts it;
    elsewhere it goes on in a thread that is no longer waited for."""
    if threading.current_thread() is threading.main_thread():

        def late(signum, frame):
            raise Overdue(f"over {seconds:g} s")

        before = signal.signal(signal.SIGALRM, late)
        signal.setitimer(signal.ITIMER_REAL, seconds)
        try:
            return f(*args)
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)
    out: list = []

    def run() -> None:
        try:
            out.append((f(*args), None))
        except Exception as e:  # noqa: BLE001 - handed to the caller
            out.append((None, e))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not out:
        raise Overdue(f"over {seconds:g} s")
    value, error = out[0]
    if error is not None:
        raise error
    return value
