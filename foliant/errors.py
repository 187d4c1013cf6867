"""Errors of this package. A row that fails becomes a row with a warning; these are for whole calls."""

from __future__ import annotations


class DocumentError(Exception):
    """Base of all."""


class UnsupportedFormatError(DocumentError):
    """No parser has the file's suffix."""


class ParsingError(DocumentError):
    """A parser failed; ``parser`` names it and ``original_error`` is what it met."""

    def __init__(self, message: str, parser: str | None = None, original_error: Exception | None = None):
        super().__init__(message)
        self.parser, self.original_error = parser, original_error


class FileReadError(DocumentError):
    """A file can't be read."""


class NetworkError(DocumentError):
    """A fetch failed."""


class ValidationError(DocumentError):
    """Input that no parser may take."""
