"""Raster analytics on Spark: images and frames as pixel tables."""
