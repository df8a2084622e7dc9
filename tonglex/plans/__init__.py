"""Registered queries over the driver's tables, each with a DuckDB counterpart."""

from __future__ import annotations

from .lexicon_queries import LEXICON
from .part_queries import PART
from .text_queries import TEXT

_ALL = TEXT | LEXICON | PART
QUERIES = {k: v[0] for k, v in _ALL.items()}
ORACLES = {k: v[1] for k, v in _ALL.items()}
