"""Every operator bound to the test tables, each with the SQL that must agree with it."""

from postmill.bindings import (  # noqa: F401  (registration)
    lifecycle, links, pages, prefs, runs, scoring, streams, tables, upserts,
)
from postmill.bindings.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
