"""Registered plans: one per operator, each with equivalent ANSI SQL where SQL
can say it.  Importing this package fills the registry."""

from fieldtally.plans import (  # noqa: F401
    audits,
    designs,
    inference,
    joins,
    missing,
    rows,
    sources,
    streams,
    summaries,
    windows,
)
from fieldtally.plans.base import REGISTRY

__all__ = ["REGISTRY"]
