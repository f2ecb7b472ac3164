"""External programs: where they are found, and how they are run."""

from __future__ import annotations

import os
import shutil
import subprocess
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from strandline.errors import EngineError

#: Characters of a program's error output that are held, and that an error shows.
TAIL, SHOWN = 32_000, 2_000


def find_tool(name: str, setting: str | None = None, bundled: str | None = None) -> str:
    """The program's path: the setting if given, else what the search path has, else the bundled one."""
    found = setting or shutil.which(name) or (bundled if bundled and os.path.isfile(bundled) else None)
    if not found:
        raise EngineError("TOOL_MISSING", f"{name} was not found", f"install {name} or name its path in the settings")
    return found


@dataclass(frozen=True)
class Output:
    stdout: bytes
    stderr: str


def run_tool(path: str, args: list[str], timeout: float | None = None, stop: threading.Event | None = None, told: Callable[[str], None] | None = None) -> Output:
    """Runs a program to its end: its output, and the tail of what it said on the error stream.

    It is killed when ``stop`` is set or the time is over; an exit code other than 0 is an error.
    """
    name = os.path.basename(path)
    if stop is not None and stop.is_set():
        raise EngineError("CANCELLED", f"{name} was cancelled")
    try:
        child = subprocess.Popen([path, *args], stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE)
    except OSError as e:
        raise EngineError("TOOL_FAILED", f"could not start {name}: {e}") from e
    out, said = [], [""]

    def listen() -> None:
        for raw in iter(lambda: child.stderr.read1(65_536), b""):
            text = raw.decode("utf-8", "replace")
            said[0] = (said[0] + text)[-TAIL:]
            if told is not None:
                told(text)

    readers = [threading.Thread(target=lambda: out.append(child.stdout.read()), daemon=True), threading.Thread(target=listen, daemon=True)]
    for r in readers:
        r.start()
    ends, why = None if timeout is None else time.monotonic() + timeout, None
    while why is None:
        try:
            child.wait(0.05)
            break
        except subprocess.TimeoutExpired:
            if stop is not None and stop.is_set():
                why = EngineError("CANCELLED", f"{name} was cancelled")
            elif ends is not None and time.monotonic() > ends:
                why = EngineError("TIMEOUT", f"{name} took more than {timeout:g} s")
    if why is not None:
        child.kill()
        child.wait()
    for r in readers:
        r.join()
    if why is not None:
        raise why
    if child.returncode:
        raise EngineError("TOOL_FAILED", f"{name} ended with code {child.returncode}: {said[0][-SHOWN:]}", "the file may be damaged or of a kind the program can't read")
    return Output(b"".join(out), said[0])
