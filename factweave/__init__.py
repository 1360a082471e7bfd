"""factweave: a PySpark-native engine for rule-based semantic compression of relational facts."""

__version__ = "0.1.0"
