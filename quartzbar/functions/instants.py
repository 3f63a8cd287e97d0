"""Instants written as text."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

_ISO = re.compile(
    r"([0-9]{4})-?([0-9]{2})-?([0-9]{2})[T ]([0-9]{2}):?([0-9]{2})(?::?([0-9]{2})(?:[.,]([0-9]+))?)?"
    r"(?:(Z)|([+-])([0-9]{2})(?::?([0-9]{2}))?)?"
)


def iso_us(cell: str) -> int | None:
    """Microseconds since 1970 of an ISO 8601 date and time (without offset: UTC); None if it is none."""
    m = _ISO.fullmatch(cell)
    if not m:
        return None
    year, month, day, hour, minute, second = (int(x or 0) for x in m.groups()[:6])
    try:
        at = datetime(year, month, day, 0 if hour == 24 else hour, minute, second, tzinfo=timezone.utc)
    except ValueError:
        return None
    if hour == 24:
        if minute or second:
            return None
        at += timedelta(days=1)
    offset = (int(m[10]) * 60 + int(m[11] or 0)) * (-1 if m[9] == "-" else 1) if m[9] else 0
    micros = int((m[7] or "0")[:6].ljust(6, "0"))
    return int((at - timedelta(minutes=offset)).timestamp()) * 1_000_000 + micros


# Milliseconds of the interval codes; unknown ones are minutes.
INTERVAL_MS = {
    "1m": 60_000, "3m": 180_000, "5m": 300_000, "15m": 900_000, "30m": 1_800_000, "1h": 3_600_000, "2h": 7_200_000, "4h": 14_400_000,
    "6h": 21_600_000, "8h": 28_800_000, "12h": 43_200_000, "1d": 86_400_000, "3d": 259_200_000, "1w": 604_800_000, "1M": 2_592_000_000,
}


def interval_ms(code: str) -> int:
    return INTERVAL_MS.get(code, INTERVAL_MS["1m"])
