"""Checkable statistical analytics over long tables, expressed as Spark DataFrame and SQL plans."""
