"""Strandline: retrieval analytics and corpus processing as declarative Spark plans."""
