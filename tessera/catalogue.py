"""The registry of queries: name -> (query, SQL or None)."""

from __future__ import annotations

_ALL: dict = {}


def register(name: str, sql: str | None = None):
    def put(f):
        _ALL[name] = (f, sql)
        return f

    return put


def queries() -> dict:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _ALL.items() if s}


from . import plans  # noqa: E402, F401  fills the registry
