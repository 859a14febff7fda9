"""PySpark-native analytics over evidence-grounded reviews and text corpora."""

__version__ = "0.1.0"
