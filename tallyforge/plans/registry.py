"""All queries of the engine, by operator id, and the SQL that gives the same rows."""

from __future__ import annotations

from . import corpora, files, selection, statistics, textual, training  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401

FLAGSHIP = "agg14_agg15_method_report"
