"""A strict, read-only SELECT dialect with SQLite semantics, on Spark DataFrames."""

from sparrowql.engine import Engine, Statement, render
from sparrowql.errors import (
    BindError,
    EngineError,
    IntegerOverflowError,
    ParseError,
    SemanticError,
    SourceError,
    UnsupportedError,
)

__all__ = [
    "BindError",
    "Engine",
    "EngineError",
    "IntegerOverflowError",
    "ParseError",
    "SemanticError",
    "SourceError",
    "Statement",
    "UnsupportedError",
    "render",
]
