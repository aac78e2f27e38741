"""Spark-native analytics for point clouds, habitat rasters and document corpora."""
