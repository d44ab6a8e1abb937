"""Leak-free temporal features and forecast evaluation as Spark plans."""
