"""Errors that the engine raises."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors of the engine."""


class ParseError(EngineError):
    """The text isn't in the grammar."""


class SemanticError(EngineError):
    """A name can't be resolved, or is ambiguous, or a position is out of range."""


class UnsupportedError(EngineError):
    """The text is understood, but outside what the dialect supports."""


class BindError(EngineError):
    """A bound value has a type that its place doesn't take."""


class IntegerOverflowError(EngineError):
    """An integer sum doesn't fit 64 bits."""


class SourceError(EngineError):
    """A file or database can't be read as tables."""
