"""Typed errors: what is outside the supported surface is refused with a code, never approximated."""

from __future__ import annotations

from typing import Any

#: The codes that callers match on.
CODES = (
    "BUDGET_EXCEEDED",
    "CATALOG_ERROR",
    "COMMIT_CONFLICT",
    "GROUP_LIMIT_EXCEEDED",
    "INVALID_BOOKMARK",
    "INVALID_EXPRESSION",
    "INVALID_QUERY",
    "JOIN_LIMIT_EXCEEDED",
    "MISSING_GEO_BACKEND",
    "NOT_FOUND",
    "NO_FILES_MATCHED",
    "PARSE_ERROR",
    "POLICY_VIOLATION",
    "SCHEMA_CONFLICT",
    "SNAPSHOT_MISMATCH",
    "STALE_BOOKMARK",
    "TYPE_ERROR",
    "UNKNOWN_COLUMN",
    "UNSUPPORTED_DELETE",
    "UNSUPPORTED_ICEBERG_FEATURE",
    "UNSUPPORTED_PARQUET_FEATURE",
    "UNSUPPORTED_PUSHDOWN",
    "UNSUPPORTED_SQL",
    "VALIDATION_ERROR",
)


class LakeError(Exception):
    """An error with a code of ``CODES``, a message and details."""

    def __init__(self, code: str, message: str, details: dict[str, Any] | None = None):
        if code not in CODES:
            raise ValueError(f"unknown error code {code}")
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.details = code, message, details or {}

    def as_dict(self) -> dict[str, Any]:
        return {"code": self.code, "message": self.message, "details": self.details}
