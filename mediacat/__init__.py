"""mediacat: analytics over media catalogs, written as PySpark DataFrame operators."""

__version__ = "0.1.0"
