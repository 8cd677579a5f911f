"""Name -> query and name -> DuckDB SQL, over the driver's tables."""

from __future__ import annotations

from . import checks, detection, mentions  # noqa: F401  each module registers its queries
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
