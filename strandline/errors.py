"""The engine's error: a code, a message and a hint."""

from __future__ import annotations

#: The codes that results and job records carry.
CODES = (
    "INVALID_ARGUMENT",
    "SOURCE_NOT_FOUND",
    "SOURCE_UNSUPPORTED",
    "SOURCE_TOO_LONG",
    "SOURCE_TOO_LARGE",
    "SOURCE_BLOCKED",
    "DOWNLOAD_FAILED",
    "TOOL_MISSING",
    "TOOL_FAILED",
    "MODEL_MISSING",
    "MODEL_LOAD_FAILED",
    "PIPELINE_EMPTY_OUTPUT",
    "JOB_NOT_FOUND",
    "JOB_NOT_DONE",
    "CANCELLED",
    "INTERRUPTED",
    "TIMEOUT",
    "OFFLINE",
    "IO_FAILED",
    "INTERNAL",
)


class EngineError(Exception):
    def __init__(self, code: str, message: str, hint: str | None = None) -> None:
        if code not in CODES:
            raise ValueError(f"unknown code {code}")
        super().__init__(message)
        self.code, self.message, self.hint = code, message, hint

    def as_dict(self) -> dict[str, str | None]:
        return {"code": self.code, "message": self.message, "hint": self.hint}
