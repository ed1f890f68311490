"""Functions whose meaning differs from Spark's own, as Columns and as SQL text."""
