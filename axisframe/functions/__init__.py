"""Scalar conversions between element types."""
