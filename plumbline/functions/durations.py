"""Compact durations such as ``2h`` or ``-1d``."""

from __future__ import annotations

import datetime as dt
import re

from plumbline.errors import RuleConfigError

# The accepted unit letters, in minutes.
MINUTES = {"m": 1, "h": 60, "d": 1440}
_DURATION = re.compile(rf"\s*(?P<amount>-?\d+)(?P<unit>[{''.join(MINUTES)}])\s*", re.IGNORECASE)


def parse_duration(text: str) -> dt.timedelta:
    """``'90m'`` -> 90 minutes.  A leading minus is allowed and taken literally."""
    parts = _DURATION.fullmatch(text)
    if not parts:
        raise RuleConfigError(f"'{text}' is no duration such as 30m, 2h or -1d")
    return int(parts["amount"]) * dt.timedelta(minutes=MINUTES[parts["unit"].lower()])
