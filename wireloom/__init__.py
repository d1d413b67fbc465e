"""A PySpark engine for open hypergraphs kept as relational tables."""
