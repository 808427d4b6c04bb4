"""All registered queries of the evidence operators, with the SQL that gives the same rows."""

from __future__ import annotations

from . import forests, more, pages, scans, usages
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "forests", "more", "pages", "scans", "usages"]
