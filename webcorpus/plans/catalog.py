"""All registered queries."""

from __future__ import annotations

from . import crawling, flagship, hosts, research, streams, watching, web  # noqa: F401
from .registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
