"""An append-only folder of raw responses: every fetch is kept, the newest answers."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import time
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path


def request_key(endpoint: str, params: dict) -> str:
    """Sixteen hexadecimal digits of the canonical request."""
    text = json.dumps([endpoint, {k: params[k] for k in sorted(params)}], separators=(",", ":"))
    return hashlib.sha1(text.encode()).hexdigest()[:16]


class RawStore:
    def __init__(self, root: str | Path, fetch: Callable[[str, dict], dict]):
        self.root, self.fetch = Path(root), fetch

    def newest(self, endpoint: str, partition: str, params: dict) -> Path | None:
        found = sorted((self.root / endpoint / partition).glob(f"{request_key(endpoint, params)}-*.json"))
        return found[-1] if found else None

    def get(self, endpoint: str, partition: str, refresh: bool = False, **params) -> dict:
        """The newest stored response, or a fetched one, which is stored and never overwritten."""
        known = self.newest(endpoint, partition, params)
        if known and not refresh:
            return json.loads(known.read_text())
        now = datetime.now(UTC)
        document = {"key": request_key(endpoint, params), "endpoint": endpoint, "season": partition, "params": params, "fetched_at": now.isoformat(), "response": self.fetch(endpoint, params)}
        folder = self.root / endpoint / partition
        folder.mkdir(parents=True, exist_ok=True)
        with tempfile.NamedTemporaryFile("w", dir=folder, suffix=".part", delete=False) as f:
            json.dump(document, f)
        for k in range(1000):
            try:
                os.link(f.name, folder / f"{document['key']}-{now:%Y%m%dT%H%M%S%f}-{k:03d}.json")
                break
            except FileExistsError:
                continue
        os.unlink(f.name)
        return document


def patient(call: Callable[[], dict], tries: int = 5, first: float = 2.0, most: float = 120.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """Calls again after failures and empty answers, waiting twice as long each time."""
    wait = first
    for k in range(tries):
        try:
            answer = call()
            if answer:
                return answer
            raise OSError("an empty answer")
        except OSError:
            if k == tries - 1:
                raise
            sleep(min(wait, most))
            wait *= 2
    raise AssertionError
