"""The queries of the library's own operators, with the SQL they are compared with."""

from __future__ import annotations

from importlib import import_module

MODULES = ("trace_queries", "packet_queries", "signal_queries", "media_queries", "stream_queries")


def _all(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"streamworks.jobs.{module}"), name)
    return out


def queries() -> dict:
    return _all("Q")


def oracle_sql() -> dict:
    return _all("S")
