"""Domain errors and the value-or-error pair."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


class DomainError(Exception):
    """Base of the errors that callers tell apart."""


class NotFound(DomainError): ...


class Conflict(DomainError):
    """A key is taken. keys: the (entity_id, sequence) pairs, if known."""

    def __init__(self, message: str, keys: list | None = None):
        super().__init__(message)
        self.keys = keys or []


class NoOp(DomainError): ...


class BadCommand(DomainError):
    def __init__(self, command: Any):
        super().__init__(f"Command not recognized: {command}")
        self.command = command


class BadEvent(DomainError):
    def __init__(self, event: Any):
        super().__init__(f"Event not recognized: {event}")
        self.event = event


class DuplicateCommand(DomainError):
    """The command was handled before; callers take it as done."""

    def __init__(self, command_id: str):
        super().__init__(f"duplicate command: {command_id}")
        self.command_id = command_id


class ReplayStrictness(DomainError):
    """Replay failed closed; phase is upcast or deserialize."""

    def __init__(self, event_type: str, version: int, phase: str, message: str = ""):
        super().__init__(message)
        self.event_type, self.version, self.phase = event_type, version, phase


class Uncovered(DomainError):
    """A compaction that no snapshot covers."""


@dataclass(frozen=True)
class Result:
    """A value or an error."""

    value: Any = None
    error: Exception | None = None

    @staticmethod
    def of(f: Callable[[], Any]) -> Result:
        try:
            return Result(f())
        except Exception as e:  # noqa: BLE001
            return Result(error=e)

    @property
    def ok(self) -> bool:
        return self.error is None

    def unwrap(self) -> Any:
        if self.error is not None:
            raise self.error
        return self.value

    def map(self, f: Callable[[Any], Any]) -> Result:
        return Result(f(self.value)) if self.ok else self

    def bind(self, f: Callable[[Any], Result]) -> Result:
        return f(self.value) if self.ok else self

    def zip(self, other: Result) -> Result:
        return Result((self.value, other.value)) if self.ok and other.ok else Result(error=self.error or other.error)

    def or_else(self, default: Any) -> Any:
        return self.value if self.ok else default


@dataclass
class Summary:
    """What a rebuild did."""

    processed: int = 0
    skipped: int = 0
    errors: list[str] = field(default_factory=list)
