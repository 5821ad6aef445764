import re
from pathlib import Path

import pytest

from hoopspark import session


def _resident(pid: int) -> float:
    """MB of a process without mapped files."""
    return int(re.search(r"RssAnon:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) / 1024


@pytest.mark.skipif(not Path("/proc/self/status").exists(), reason="memory can't be read here")
def test_the_driver_gives_freed_memory_back(spark, monkeypatch):
    """Memory outside the heap that is free, but below some that is not, goes back to the machine with the shuffles."""
    jvm = spark._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    used = [jvm.java.util.zip.Deflater() for _ in range(600)]
    for one in used[:-1]:
        one.end()
    for _ in range(2):
        jvm.System.gc()
    before = _resident(pid)
    monkeypatch.setattr(session, "_looked", float("-inf"))
    session.give_up_shuffles(spark)
    after = _resident(pid)
    used[-1].end()
    assert after < before - 40
