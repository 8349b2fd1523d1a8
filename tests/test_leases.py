"""Leases: one of two sessions runs, a lost holder's time ends, and its late write is refused."""

import os
import subprocess
import sys
import threading
import time

import pytest

from assayer.sinks import versions
from assayer.streaming import leases

OTHER = "import sys; from assayer.streaming import leases; leases.acquire(sys.argv[1], 'job', 60); print('runs')"


def test_one_of_two_sessions_runs(tmp_path):
    lease = leases.acquire(str(tmp_path), "job")
    other = subprocess.run([sys.executable, "-c", OTHER, str(tmp_path)], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert other.returncode and "Held" in other.stderr
    leases.acquire(str(tmp_path), "another")
    lease.release()
    with pytest.raises(leases.Lost):
        lease.check()
    other = subprocess.run([sys.executable, "-c", OTHER, str(tmp_path)], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert other.stdout == "runs\n"
    with pytest.raises(leases.Held):  # its process has ended without giving it back
        leases.acquire(str(tmp_path), "job")


def test_one_of_many_threads_gets_it(tmp_path):
    got, barrier = [], threading.Barrier(8)

    def take():
        barrier.wait()
        try:
            got.append(leases.acquire(str(tmp_path), "job").number)
        except leases.Held:
            pass

    threads = [threading.Thread(target=take) for _ in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got == [1]


def test_a_lost_holder_is_fenced_off(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.range(3)
    lost = leases.acquire(str(tmp_path), "job", 0.3)
    time.sleep(0.4)
    mine = leases.acquire(str(tmp_path), "job")
    assert mine.number == lost.number + 1
    for late in (lost.check, lost.renew):
        with pytest.raises(leases.Lost):
            late()
    with pytest.raises(Exception, match="not the last one"):
        versions.publish(rows, path, 0, fence=lost.fence())
    assert versions.latest(path) == 0 and os.listdir(path + "/data") == []
    assert versions.publish(rows, path, 0, fence=mine.fence()) == 1
    mine.renew()
    assert leases.until(mine.folder, mine.number) > time.time() + 50


def test_single_flight(tmp_path):
    def run(lease):
        with pytest.raises(leases.Held):
            leases.single_flight(str(tmp_path), "job", lambda _: None)
        return lease.number

    assert leases.single_flight(str(tmp_path), "job", run) == 1
    with pytest.raises(ZeroDivisionError):
        leases.single_flight(str(tmp_path), "job", lambda _: 1 / 0)
    assert not leases.taken(str(tmp_path / "job"))
