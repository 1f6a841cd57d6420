"""Column-level functions: every one returns a ``pyspark.sql.Column``."""
