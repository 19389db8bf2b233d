"""Outcome codes and results of statements. Nothing is raised across the Database API."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from typing import Any


class StatusCode(Enum):
    OK = "ok"
    ERROR = "error"
    NOT_FOUND = "not found"
    ALREADY_EXISTS = "already exists"
    INVALID_ARGUMENT = "invalid argument"
    IO_ERROR = "io error"
    CORRUPTION = "corruption"
    NOT_SUPPORTED = "not supported"
    OUT_OF_MEMORY = "out of memory"
    BUSY = "busy"
    TIMEOUT = "timeout"
    ABORTED = "aborted"
    INTERNAL = "internal"


class SqlError(Exception):
    def __init__(self, code: StatusCode, message: str):
        super().__init__(message)
        self.code, self.message = code, message


def invalid(message: str) -> SqlError:
    return SqlError(StatusCode.INVALID_ARGUMENT, message)


def unsupported(message: str) -> SqlError:
    return SqlError(StatusCode.NOT_SUPPORTED, message)


@dataclass
class Result:
    """Column names and rows of a query, or the number of rows a change touched, or an error."""

    columns: list[str] = field(default_factory=list)
    rows: list[tuple[Any, ...]] = field(default_factory=list)
    affected: int = 0
    code: StatusCode = StatusCode.OK
    message: str = ""

    @property
    def ok(self) -> bool:
        return self.code is StatusCode.OK

    def scalar(self) -> Any:
        return self.rows[0][0]
