"""inkmill: a PySpark-native engine for building, cleaning, de-duplicating, packing and scoring corpora of figure code."""

__version__ = "0.1.0"
