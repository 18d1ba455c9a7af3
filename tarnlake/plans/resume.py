"""Positions in a query that can be stored and resumed: fingerprints, bookmarks, signed tokens, manifests, checkpoints."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
import time
from dataclasses import dataclass, field
from typing import Any

from tarnlake.errors import LakeError

#: A task's states in their order.
STATES = ("planned", "running", "output-written", "manifest-recorded", "complete")


def stable_json(value: Any) -> str:
    """JSON with keys in order and no spaces: equal values give equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def fingerprint(value: Any) -> str:
    """``fp_`` and the 64-bit FNV-1a hash of the stable JSON."""
    h = 0xCBF29CE484222325
    for b in stable_json(value).encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"fp_{h:016x}"


@dataclass(frozen=True)
class Bookmark:
    """A position in a plan's result: the first row not yet read.

    ``after`` has the sort keys of the last row read and how many rows with just these keys were read, where they can be
    written as JSON; reading goes on from there without passing over the rows before.
    """

    plan_fingerprint: str
    row_offset: int
    snapshot: str = ""
    file_index: int = 0
    row_group: int = 0
    query: dict | None = None
    version: int = 1
    after: dict | None = None

    def as_dict(self) -> dict:
        d = {"version": self.version, "planFingerprint": self.plan_fingerprint, "snapshot": self.snapshot, "position": {"fileIndex": self.file_index, "rowGroup": self.row_group, "rowOffset": self.row_offset}}
        return d | ({"query": self.query} if self.query is not None else {}) | ({"after": self.after} if self.after is not None else {})

    @staticmethod
    def from_dict(d: Any) -> Bookmark:
        try:
            p = d["position"]
            if d["version"] != 1 or any(not isinstance(p[k], int) or p[k] < 0 for k in ("fileIndex", "rowGroup", "rowOffset")):
                raise KeyError("position")
            return Bookmark(str(d["planFingerprint"]), p["rowOffset"], str(d["snapshot"]), p["fileIndex"], p["rowGroup"], d.get("query"), after=d.get("after"))
        except (KeyError, TypeError) as e:
            raise LakeError("INVALID_BOOKMARK", "not a bookmark") from e

    def check(self, plan_fingerprint: str) -> None:
        """Refuse to go on under another plan."""
        if self.plan_fingerprint != plan_fingerprint:
            raise LakeError("STALE_BOOKMARK", "the bookmark is of another plan", {"bookmark": self.plan_fingerprint, "plan": plan_fingerprint})


def _b64(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def _secret(secret: str | bytes) -> bytes:
    return secret.encode() if isinstance(secret, str) else secret


def sign_token(bookmark: Bookmark, secret: str | bytes) -> str:
    """A bookmark as text that can't be changed without the secret."""
    payload = stable_json(bookmark.as_dict()).encode()
    return f"{_b64(payload)}.{_b64(hmac.digest(_secret(secret), payload, 'sha256'))}"


def verify_token(token: str, secret: str | bytes) -> Bookmark:
    parts = token.split(".")
    try:
        if len(parts) != 2 or not all(parts):
            raise ValueError
        payload = base64.b64decode(parts[0] + "=" * (-len(parts[0]) % 4), altchars=b"-_", validate=True)
    except ValueError as e:
        raise LakeError("INVALID_BOOKMARK", "a token is a payload and a signature") from e
    if not hmac.compare_digest(parts[1], _b64(hmac.digest(_secret(secret), payload, "sha256"))):
        raise LakeError("INVALID_BOOKMARK", "the token's signature is wrong")
    return Bookmark.from_dict(json.loads(payload))


@dataclass
class Checkpoint:
    task_id: str
    state: str
    idempotency_key: str
    updated_at_ms: int = 0
    outputs: list[dict] = field(default_factory=list)

    def as_dict(self) -> dict:
        return {"taskId": self.task_id, "state": self.state, "idempotencyKey": self.idempotency_key, "updatedAtMs": self.updated_at_ms, "outputs": self.outputs}


class Checkpoints:
    """Checkpoints of tasks, in memory or, with ``folder``, in a file per task that is replaced whole."""

    def __init__(self, folder: str | None = None):
        self.folder, self._known = folder, {}
        if folder:
            os.makedirs(folder, exist_ok=True)

    def _path(self, task_id: str) -> str:
        return os.path.join(self.folder, hashlib.sha256(task_id.encode()).hexdigest()[:32] + ".json")

    def get(self, task_id: str) -> Checkpoint | None:
        if not self.folder:
            return self._known.get(task_id)
        try:
            with open(self._path(task_id)) as f:
                d = json.load(f)
        except FileNotFoundError:
            return None
        return Checkpoint(d["taskId"], d["state"], d["idempotencyKey"], d["updatedAtMs"], d["outputs"])

    def put(self, c: Checkpoint) -> None:
        if not self.folder:
            self._known[c.task_id] = c
            return
        temporary = self._path(c.task_id) + f".{os.getpid()}.tmp"
        with open(temporary, "w") as f:
            f.write(stable_json(c.as_dict()))
        os.replace(temporary, self._path(c.task_id))

    def advance(self, task_id: str, state: str, idempotency_key: str, outputs: list[dict] | None = None) -> Checkpoint:
        """Move a task on. States only go forward, and one key belongs to one task's run."""
        if state not in STATES:
            raise LakeError("VALIDATION_ERROR", f"unknown state {state}")
        old = self.get(task_id)
        if old and old.idempotency_key != idempotency_key and old.state != "complete":
            raise LakeError("COMMIT_CONFLICT", "the task is run under another key", {"task": task_id})
        if old and old.idempotency_key == idempotency_key and STATES.index(state) < STATES.index(old.state):
            raise LakeError("VALIDATION_ERROR", f"a task can't go from {old.state} back to {state}")
        new = Checkpoint(task_id, state, idempotency_key, int(time.time() * 1000), outputs if outputs is not None else (old.outputs if old else []))
        self.put(new)
        return new


def task_manifest(job_id: str, plan_fingerprint: str, snapshot: str, tasks: list[dict]) -> dict:
    """A job's tasks, in order of path and first row group, with an id of each."""
    ordered = sorted(tasks, key=lambda t: (t["path"], t.get("rowGroupRanges", [{"start": 0}])[0]["start"]))
    named = [t | {"taskId": f"{job_id}-task-{i:06d}-{fingerprint(t)[3:11]}"} for i, t in enumerate(ordered)]
    return {"version": 1, "jobId": job_id, "planFingerprint": plan_fingerprint, "snapshot": snapshot, "tasks": named}


def output_manifest(job_id: str, plan_fingerprint: str, entries: list[dict]) -> dict:
    """What a job has written: an entry per file in order of path, each with a hash over its own fields."""
    hashed = [e | {"contentHash": e.get("contentHash") or fingerprint(e)} for e in sorted(entries, key=lambda e: e["outputPath"])]
    return {"version": 1, "jobId": job_id, "planFingerprint": plan_fingerprint, "entries": hashed}


def plan_work_units(groups: list[dict], path: str, max_row_groups: int = 1, max_rows: int | None = None) -> list[dict]:
    """Row groups (of ``sources.readers.row_groups``) as tasks of at most so many groups and, unless one alone has more, rows."""
    units: list[list[dict]] = []
    for g in groups:
        last = units[-1] if units else None
        if last and len(last) < max_row_groups and (max_rows is None or sum(x["rows"] for x in last) + g["rows"] <= max_rows):
            last.append(g)
        else:
            units.append([g])
    return [{"path": path, "rowGroupRanges": [{"start": u[0]["row_group"], "end": u[-1]["row_group"] + 1}], "rows": sum(x["rows"] for x in u), "partitionValues": {}} for u in units]
