"""Run manifest on the driver: content-addressed results of finished work, a journal, and cost estimates."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

ATTEMPTS, STALE_SECONDS = 3, 3600


def work_key(kind: str, inputs: dict, **more: str | None) -> str:
    """Name of a unit of work by its content; the order of inputs does not matter."""
    return hashlib.sha256(json.dumps({"kind": kind, "inputs": inputs, **more}, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def tags_version(tags: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(tags)).encode()).hexdigest()[:12]


def write_durably(path: Path, data: str) -> None:
    """Write a file so that it is either whole on disk or not there."""
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


class Manifest:
    """Results of work by key, one file each; a key that failed ``ATTEMPTS`` times is not tried again."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def _path(self, key: str) -> Path:
        return self.folder / f"{key}.json"

    def find(self, key: str) -> dict | None:
        return json.loads(self._path(key).read_text(encoding="utf-8")) if self._path(key).exists() else None

    def run(self, kind: str, inputs: dict, work: Callable[[], object], force: bool = False) -> dict:
        """The stored result, or that of ``work``, which is recorded: done with its output, or failed with its error."""
        key = work_key(kind, inputs)
        held = self.find(key)
        if held and held["status"] == "done" and not force:
            return held | {"cached": True}
        attempts = 0 if not held or force else held["attempts"]
        if attempts >= ATTEMPTS:
            return held | {"cached": True}
        entry = {"key": key, "kind": kind, "inputs": inputs, "status": "running", "attempts": attempts + 1, "started": datetime.now(UTC).isoformat(timespec="seconds")}
        write_durably(self._path(key), json.dumps(entry, default=str))
        try:
            entry |= {"status": "done", "output": work()}
        except Exception as e:  # recorded and returned: one unit's failure does not end a run
            entry |= {"status": "failed", "error": str(e)[:500]}
        write_durably(self._path(key), json.dumps(entry, default=str))
        return entry | {"cached": False}

    def resumable(self, now: datetime | None = None) -> list[dict]:
        """Work that failed and may be tried again, or was begun and given up."""
        now = now or datetime.now(UTC)
        out = []
        for p in sorted(self.folder.glob("*.json")):
            e = json.loads(p.read_text(encoding="utf-8"))
            stale = e["status"] == "running" and (now - datetime.fromisoformat(e["started"])).total_seconds() > STALE_SECONDS
            if (e["status"] == "failed" or stale) and e["attempts"] < ATTEMPTS:
                out.append(e)
        return out

    def counts(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for p in self.folder.glob("*.json"):
            s = json.loads(p.read_text(encoding="utf-8"))["status"]
            out[s] = out.get(s, 0) + 1
        return out


def append_entry(folder: str | Path, entry: dict, stem: str) -> Path:
    """Write a decision as a file of its own; nothing that was written is touched."""
    folder = Path(folder)
    stamp = datetime.now(UTC).strftime("%Y%m%dT%H%M%S")
    n = 1
    while (path := folder / f"{stamp}-{stem}{'' if n == 1 else f'-{n}'}.json").exists():
        n += 1
    write_durably(path, json.dumps(entry, indent=2, default=str))
    return path


def pass_over(folder: str | Path, cik: int, reason: str) -> Path:
    """Record that a candidate was rejected, and why."""
    if not reason.strip():
        raise ValueError("a reason is required")
    return append_entry(folder, {"cik": cik, "decision": "pass", "reason": reason}, f"pass-{cik}")


@dataclass(frozen=True)
class Cost:
    """Cost of calls to a model, from its prices for a million tokens."""

    model: str
    usd: float
    input_tokens: int = 0
    output_tokens: int = 0
    cached_tokens: int = 0
    calls: int = 1

    @classmethod
    def estimate(cls, model: str, input_price: float, output_price: float, input_tokens: int = 0, output_tokens: int = 0, cached_tokens: int = 0, calls: int = 1, cached_share: float = 0.1) -> Cost:
        usd = (input_tokens * input_price + cached_tokens * input_price * cached_share + output_tokens * output_price) / 1e6 * calls
        return cls(model, usd, input_tokens, output_tokens, cached_tokens, calls)

    @classmethod
    def total(cls, costs: list[Cost]) -> Cost:
        if not costs:
            return cls("none", 0.0, calls=0)
        models = {c.model for c in costs}
        return cls(models.pop() if len(models) == 1 else "mixed", *(sum(getattr(c, n) for c in costs) for n in ("usd", "input_tokens", "output_tokens", "cached_tokens", "calls")))

    def human(self) -> str:
        return f"${self.usd:.4f}" if 0 < self.usd < 0.01 else f"${self.usd:,.2f}"

    def check(self, ceiling: float) -> None:
        if self.usd > ceiling:
            raise ValueError(f"projected cost {self.human()} is over the ceiling of ${ceiling:,.2f}")
