"""millrace: a PySpark-native engine for curating question/answer and free-text training data."""

__version__ = "0.1.0"
