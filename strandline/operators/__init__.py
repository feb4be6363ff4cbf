"""Operators over DataFrames: retrieval, packing, merging, learning, chunking."""
