"""A kernel's time budget, checked between rounds."""

from __future__ import annotations

import threading
import time
import uuid


class Deadline:
    """Raises TimeoutError once ``seconds`` have passed; 0: never."""

    def __init__(self, seconds: float = 0):
        self.seconds = seconds
        self.end = time.monotonic() + seconds if seconds else None

    def check(self) -> None:
        if self.end is not None and time.monotonic() > self.end:
            raise TimeoutError(f"over {self.seconds} s")


def limited(spark, seconds: float, action):
    """What ``action()`` returns, or TimeoutError if it took longer; 0: no limit.

    Jobs that run when the time is over are cancelled. Where it ends between two jobs, later ones are
    cancelled as they start: the timer fires again until the action has returned.
    """
    if not seconds:
        return action()
    context, tag, over = spark.sparkContext, f"limit-{uuid.uuid4().hex}", threading.Event()
    end = time.monotonic() + seconds

    def watch() -> None:
        while not over.wait(max(0.05, min(0.5, end - time.monotonic()))):
            if time.monotonic() >= end:
                context.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        result = action()
    except Exception as error:
        if time.monotonic() >= end:
            raise TimeoutError(f"over {seconds} s") from error
        raise
    finally:
        over.set()
        watcher.join()
        context.removeJobTag(tag)
    if time.monotonic() >= end:
        raise TimeoutError(f"over {seconds} s")
    return result
