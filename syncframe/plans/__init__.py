"""Queries over the test tables, each with its SQL counterpart where SQL can express it."""

from syncframe.plans import events, planning, protocols, scalar, streams, written  # noqa: F401
from syncframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
