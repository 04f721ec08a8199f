"""Registered queries: each has a Spark form and, where SQL can state it, an equivalent SQL text."""

from .core import oracles, queries

__all__ = ["oracles", "queries"]
