"""Fetching over HTTP, with retries of what may pass."""

from __future__ import annotations

import json
import time
from http.client import HTTPException
from urllib.parse import urlencode
from urllib.request import Request, urlopen

# fixed values: attempts, and seconds that an attempt may take
ATTEMPTS = 3
TIMEOUT = 90.0
#: Seconds before the second attempt; each further wait is twice as long.
WAIT = 1.0


def fetch(url: str, attempts: int = ATTEMPTS, timeout: float = TIMEOUT, wait: float = WAIT, data: bytes | None = None, headers: dict[str, str] | None = None) -> bytes:
    """The body. Failures of the network, of the server or in transit are tried again; the last one is raised."""
    for k in range(attempts):
        try:
            with urlopen(Request(url, data, {"User-Agent": "factgrid", **(headers or {})}), timeout=timeout) as r:
                return r.read()
        except (OSError, HTTPException):
            if k == attempts - 1:
                raise
            time.sleep(wait * 2**k)
    raise ValueError("attempts must be positive")


def api(base: str, endpoint: str, attempts: int = ATTEMPTS, timeout: float = TIMEOUT, wait: float = WAIT, **params: object) -> dict:
    return json.loads(fetch(f"{base.rstrip('/')}/{endpoint}?{urlencode(params)}", attempts, timeout, wait))
