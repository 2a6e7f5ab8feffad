"""All queries over the reference tables and the SQL that answers them."""

from __future__ import annotations

from tessitura.queries import ORACLE_SQL, QUERIES

FLAGSHIP = "similarity_topk"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
