"""Linking of single-night sky detections on Spark: operators, sources, plans and streaming."""
