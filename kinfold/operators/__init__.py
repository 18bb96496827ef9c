"""Relational and matrix operators."""
