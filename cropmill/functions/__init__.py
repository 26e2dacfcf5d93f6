"""Scalar column expressions: geometry, buckets, tolerant casts and text."""
