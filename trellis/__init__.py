"""Trellis: RDF terms, graph-pattern queries and triple-shaped data processing on Spark DataFrames."""

__version__ = "0.1.0"
