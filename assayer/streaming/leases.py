"""Single flight across sessions: a lease that one holder has at a time, with a number that fences off holders that lost it.

The lease of a name is a folder that all sessions see. Taking it creates the file of the next number, which only one of several can
do; whoever created the highest number holds it until its time is over or it is given back. A holder renews its time while it
works. Each write checks the number that it was started under: with a higher one there, it is refused, however late it comes.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from ..sinks.versions import create_exclusively, local


class Held(RuntimeError):
    """Somebody else holds the lease."""


class Lost(RuntimeError):
    """The lease has gone to somebody else, or its time was over."""


def numbers(folder: str) -> list[int]:
    names = os.listdir(folder) if os.path.isdir(folder) else []
    return sorted(int(n[:-6]) for n in names if n.endswith(".lease"))


@dataclass
class Lease:
    folder: str
    number: int
    seconds: float

    def _file(self, kind: str) -> str:
        return os.path.join(self.folder, f"{self.number:012}.{kind}")

    def check(self) -> None:
        """Raises `Lost` unless this is the last lease and its time isn't over."""
        if numbers(self.folder)[-1:] != [self.number] or os.path.exists(self._file("released")):
            raise Lost(f"lease {self.number} of {self.folder} is not the last one")
        if until(self.folder, self.number) <= time.time():
            raise Lost(f"the time of lease {self.number} of {self.folder} is over")

    def renew(self) -> None:
        """Puts the end off, if the lease isn't lost."""
        self.check()
        put_until(self.folder, self.number, time.time() + self.seconds)
        if numbers(self.folder)[-1] != self.number:
            raise Lost(f"lease {self.number} of {self.folder} is not the last one")

    def release(self) -> None:
        create_exclusively(self._file("released"), "{}")

    def fence(self) -> str:
        """What a write is given to check the lease by, in another process."""
        return json.dumps([self.folder, self.number, self.seconds])


def until(folder: str, number: int) -> float:
    """When a lease ends: as it was last renewed, else as it was taken."""
    for kind in ("until", "lease"):
        try:
            with open(os.path.join(folder, f"{number:012}.{kind}")) as f:
                return float(f.read())
        except FileNotFoundError:
            pass
    return 0.0


def put_until(folder: str, number: int, when: float) -> None:
    staged = os.path.join(folder, f".{uuid.uuid4()}")
    with open(staged, "w") as f:
        f.write(repr(when))
    os.replace(staged, os.path.join(folder, f"{number:012}.until"))


def fenced(fence: str) -> None:
    """Raises `Lost` if the lease that a fence names is lost."""
    Lease(*json.loads(fence)).check()


def is_over(folder: str, number: int) -> bool:
    """Whether a lease was given back, or its time is over; number 0 stands for none."""
    return not number or os.path.exists(os.path.join(folder, f"{number:012}.released")) or until(folder, number) <= time.time()


def last_number(folder: str) -> int:
    return (numbers(folder) or [0])[-1]


def taken(folder: str) -> bool:
    """Whether somebody holds the lease now."""
    return not is_over(folder, last_number(folder))


def acquire(path: str, name: str, seconds: float = 60.0) -> Lease:
    """The lease of a name, for so many seconds; raises `Held` if another one has it, or was faster."""
    folder = os.path.join(local(path), name)
    os.makedirs(folder, exist_ok=True)
    last = last_number(folder)  # read once: whoever takes the next number has seen this one end
    lease = Lease(folder, last + 1, seconds)
    if not is_over(folder, last) or not create_exclusively(lease._file("lease"), repr(time.time() + seconds)):
        raise Held(f"already running: {name}")
    return lease


@contextmanager
def held(path: str, name: str, seconds: float = 60.0) -> Iterator[Lease]:
    lease = acquire(path, name, seconds)
    try:
        yield lease
    finally:
        lease.release()


def single_flight(path: str, name: str, run: Callable[[Lease], object], seconds: float = 60.0) -> object:
    """run(lease), unless the name is held by this session or any other that sees the folder."""
    with held(path, name, seconds) as lease:
        return run(lease)
