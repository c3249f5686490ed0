"""Relational and matrix operators of the co-clustering engine."""
