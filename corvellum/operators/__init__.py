"""Relational and statistical operators, grouped by the kind of plan they build."""
