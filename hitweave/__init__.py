"""hitweave: a Spark engine for search-hit tables, their annotation and large text collections."""

__version__ = "0.1.0"
