"""One query an operator group, each over whole tables, with the SQL that gives the same rows."""

from . import codecs, files, programs, records, sources  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
