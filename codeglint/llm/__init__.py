"""Operators for preparing training data: tokens, media, language, duplicates, privacy, mixing, quality, chat, LM scores.

Nothing else in the library imports this subpackage.  ``queries()`` and ``oracle_sql()`` list what it registers.
"""

from __future__ import annotations

from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
