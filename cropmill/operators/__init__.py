"""Relational and vector operators; every one takes and returns DataFrames."""
