"""Calls with a deadline that holds whatever the callee does: it runs in a process of its own, which is killed when time is up."""

from __future__ import annotations

import os
import pickle
import select
import struct
import subprocess
import sys
import time
from collections.abc import Callable

from pyspark import cloudpickle

TIMED_OUT, FAILED = "TIMED_OUT", "FAILED"
#: Seconds in which a process must be ready, and the share of a deadline after which one that nobody watches any more ends by itself.
START, ALONE = 120.0, 3.0

#: What the process runs. Its own output goes to the error stream, so that it cannot be taken for a reply. The system's
#: timer ends it even within a regular expression, and the end of its input does between two calls.
_LOOP = """
import os, pickle, signal, struct, sys
out = os.fdopen(os.dup(1), "wb")
os.dup2(2, 1)
source = sys.stdin.buffer
def read():
    head = source.read(4)
    return source.read(struct.unpack("<I", head)[0]) if len(head) == 4 else None
def say(value):
    out.write(value)
    out.flush()
path, call, limit = pickle.loads(read())
sys.path[:] = path
from pyspark import cloudpickle
call = cloudpickle.loads(call)
say(b"R")
while (data := read()) is not None:
    signal.setitimer(signal.ITIMER_REAL, limit)
    try:
        verdict = b"T" if call(*pickle.loads(data)) else b"F"
    except Exception:
        verdict = b"E"
    signal.setitimer(signal.ITIMER_REAL, 0)
    say(verdict)
"""


class Deadline:
    """A yes-or-no function with a deadline: ``"True"``, ``"False"``, `TIMED_OUT`, or `FAILED` if it raises or its process dies.

    One process serves all calls; after a call that took too long it is killed, waited for and started anew by the next.
    Use it as a context manager: nothing is left behind at its end.
    """

    def __init__(self, call: Callable[..., bool], seconds: float):
        self.first = pickle.dumps((sys.path, cloudpickle.dumps(call), max(0.05, ALONE * seconds)))
        self.seconds, self.process, self.started = seconds, None, 0

    def __enter__(self) -> Deadline:
        return self

    def __exit__(self, *_) -> None:
        self.stop()

    def stop(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.wait()
            for end in (self.process.stdin, self.process.stdout):
                try:
                    end.close()
                except OSError:
                    pass
            self.process = None

    def _send(self, data: bytes) -> None:
        self.process.stdin.write(struct.pack("<I", len(data)) + data)
        self.process.stdin.flush()

    def _reply(self, seconds: float) -> bytes | None:
        """One byte, or nothing where the process has ended; None when time is up."""
        until = time.monotonic() + seconds
        while (left := until - time.monotonic()) > 0:
            if select.select([self.process.stdout], [], [], left)[0]:
                return os.read(self.process.stdout.fileno(), 1)
        return None

    def _start(self) -> None:
        self.process = subprocess.Popen([sys.executable, "-c", _LOOP], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        self.started += 1
        self._send(self.first)
        if self._reply(START) != b"R":
            self.stop()
            raise RuntimeError("the process of a function with a deadline did not start")

    def __call__(self, *values) -> str:
        if self.process is None:
            self._start()
        try:
            self._send(pickle.dumps(values))
            said = self._reply(self.seconds)
        except BrokenPipeError:
            said = b""
        if said in (b"T", b"F"):
            return str(said == b"T")
        if said != b"E":
            self.stop()
        return TIMED_OUT if said is None else FAILED
