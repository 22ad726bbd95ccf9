"""Errors of the engine."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors that the engine raises on purpose."""


class ParseError(EngineError):
    def __init__(self, message: str, line: int = 0, column: int = 0):
        super().__init__(f"{message} (line {line}, column {column})" if line else message)
        self.line, self.column = line, column


class SchemaError(EngineError):
    """An unknown or repeated table or column."""


class ValidationError(EngineError):
    """A name or value that isn't allowed."""


class StorageError(EngineError):
    """Stored data that can't be read."""

    def __init__(self, message: str, file: str | None = None, row: int | None = None, position: int | None = None):
        super().__init__(message)
        self.file, self.row, self.position = file, row, position


class ConstraintViolation(EngineError):
    """A change that a primary key, unique column or foreign key forbids."""
