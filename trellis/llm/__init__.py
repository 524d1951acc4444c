"""Operators for large text and identifier collections. Nothing else in the library imports this subpackage."""
