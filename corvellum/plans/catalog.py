"""All queries on the driver's tables: name -> function of (spark, sf_dir), and name -> DuckDB SQL."""

from __future__ import annotations

from corvellum.plans import flagship, iterative, oracles, statistics
from corvellum.plans.sqlplan import duck, from_sql

_BOTH = {"paired_brand_effects": flagship.PAIRED_BRAND_EFFECTS, **statistics.SQL}

QUERIES = {name: from_sql(text) for name, text in _BOTH.items()} | iterative.QUERIES
SQL = {name: duck(text) for name, text in _BOTH.items()} | iterative.SQL | oracles.SQL
