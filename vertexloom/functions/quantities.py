"""Durations and sizes as people write them."""

from __future__ import annotations

import re

# Seconds of a unit of time, and powers of 1024 of a unit of size.
SECONDS = {"": 1, "s": 1, "m": 60, "min": 60, "h": 3600, "d": 86400}
POWERS = {"": 0, "k": 1, "m": 2, "g": 3, "t": 4}


def parse_duration(text: str) -> int:
    """Seconds of ``90``, ``10s``, ``5m``, ``4h`` or ``1d``."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]*)\s*", text.lower())
    if m is None or m[2] not in SECONDS:
        raise ValueError(f"no duration: {text!r}")
    return int(m[1]) * SECONDS[m[2]]


def parse_bytes(text: str) -> int:
    """Bytes of ``100``, ``64K``, ``1.5 MB`` or ``330G``."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([kmgt]?)i?b?\s*", text.lower())
    if m is None:
        raise ValueError(f"no size: {text!r}")
    return int(float(m[1]) * 1024 ** POWERS[m[2]])
