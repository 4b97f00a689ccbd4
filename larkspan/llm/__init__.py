"""Operators for text and vector collections. Nothing else in the library imports this subpackage."""
