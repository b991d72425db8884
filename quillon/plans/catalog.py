"""All queries over the driver's tables, and the SQL that must agree with them."""

from __future__ import annotations

from . import corpus, discovery, pages, records, replies, rules, samples, statistics, stores, streams, texts  # noqa: F401  they register themselves
from .base import REGISTRY


def queries() -> dict:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
