"""Operators for large-scale training-data preparation, independent of the rest of the library."""
