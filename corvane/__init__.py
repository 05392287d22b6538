"""Corvane: corpus and property-graph analytics as PySpark DataFrame plans."""
