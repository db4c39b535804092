"""Tracking-data and label-quality analytics expressed as Spark DataFrame plans."""
