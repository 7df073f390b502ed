"""Spark-native diagnosis and treatment of page-raster corpora."""
