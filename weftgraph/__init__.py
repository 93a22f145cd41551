"""A PySpark engine for typed property graphs and their metadata."""
