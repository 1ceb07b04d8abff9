"""Named queries with, where SQL can say it, the same query as DuckDB SQL."""
