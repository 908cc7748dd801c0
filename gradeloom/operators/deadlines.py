"""Calls of an opaque function with a deadline, inside a Python worker of a task."""

from __future__ import annotations

import multiprocessing
import os
import signal
from collections.abc import Callable

# Seconds past the deadline after which a call that ignores the timer loses its process.
GRACE = 0.5


def _late(signum, frame):
    raise TimeoutError


def _serve(fn: Callable, seconds: float, calls, others) -> None:
    """Answers one call after another until the caller is gone."""
    others.close()
    signal.signal(signal.SIGALRM, _late)
    try:
        while True:
            values = calls.recv()
            try:
                signal.setitimer(signal.ITIMER_REAL, seconds)
                try:
                    score = fn(*values)
                    score = 0.0 if score is None else float(score)
                finally:
                    signal.setitimer(signal.ITIMER_REAL, 0)
            except Exception:
                score = 0.0
            calls.send(score)
    except (EOFError, OSError, TimeoutError):
        pass
    finally:
        os._exit(0)


class Guarded:
    """`fn` with a deadline; a call that fails, ends its process or is late gives 0.

    Calls run in a child of the worker. There a timer raises when the time is up, which ends
    Python code and most waits, and the child goes on with the next call. A call that catches
    that error or sits in native code is ended with its process after `GRACE`, and a new child takes
    over. What calls leave in memory is lost with their child; nothing else of the task is.
    """

    def __init__(self, fn: Callable[..., float], seconds: float):
        self.fn, self.seconds = fn, seconds
        self._child = self._pipe = None

    def _start(self) -> None:
        here, there = multiprocessing.Pipe()
        context = multiprocessing.get_context("fork")
        self._child = context.Process(target=_serve, args=(self.fn, self.seconds, there, here), daemon=True)
        self._child.start()
        there.close()
        self._pipe = here

    def close(self) -> None:
        if self._child is not None:
            self._pipe.close()
            self._child.kill()
            self._child.join()
            self._child = None

    def __call__(self, *values) -> float:
        if self._child is None:
            self._start()
        try:
            self._pipe.send(values)
            if self._pipe.poll(self.seconds + GRACE):
                return self._pipe.recv()
        except (EOFError, OSError):
            pass
        self.close()
        return 0.0
