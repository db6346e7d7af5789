"""PySpark-native raster question-answering engine."""
