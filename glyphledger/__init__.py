"""Scan-text, raster and inventory analytics on Spark."""
