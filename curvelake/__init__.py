"""curvelake: a PySpark library for free-energy curves, feature tables and training data."""

__version__ = "0.1.0"
