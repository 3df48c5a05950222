"""A PySpark-native engine for cleaning, linking, merging and auditing record collections."""

__version__ = "0.1.0"
