"""Spatial, trajectory and segmentation analytics as Spark DataFrame plans."""
