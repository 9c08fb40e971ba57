"""Queries: each binds operators to the tables and stands beside SQL for the same result."""

from . import binaries, details, fits, frames, gates, lifecycle, measures, pieces, relations, rooms, rules, shapes, stores, summaries, timed  # noqa: F401
