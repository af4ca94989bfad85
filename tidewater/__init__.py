"""Thematic exposure analytics expressed as Spark plans."""
